"""WARC archives and their capture index.

Writing: one record per page, made by DataFrame functions, and one gzip member per record, so that a reader can start at any. A
file holds about FILE_BYTES, whatever the pages' sizes. Spark's own text writer writes them, a row a file, so files are committed
like any Spark output, on any file system; its line separator is the last byte of the file's last member, the highest byte of the
member's length, which is zero (longer records go on in a further member). Of the records with equal payloads the one with the
largest page_id is the response; the others are revisits without payload that refer to it.

Reading: the members of an archive file are read one after the other and parsed by Content-Length, whatever the payload holds; at is
where a record's member begins. The captures of a file are sorted by URL key and timestamp: a run. Runs are dealt by key range and each range merges its pieces of the runs with a loser tree, so that
the ranges in order hold the whole capture history in order.

Defined results: null html is an empty payload, and empty payloads are compared like any others; a null url has no target and
sorts first; rows with a null page_id are revisits if their payload has a row with an id, responses otherwise; rows that repeat
the largest page_id with its payload are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import scratch

from .common import stage

CRLF = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The first page's capture time; later ids follow by seconds.
EPOCH = 1_704_067_200
#: Compressed bytes from which a file is full, so that a reader's task holds a bounded file; bytes of a member at most.
FILE_BYTES, MEMBER_BYTES = 16 << 20, (16 << 20) - 1
RUN = "run string, seq long, urlkey string, captured long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, at long"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of SHA-1: eight groups of five hex digits, each four letters."""
    digest = F.sha1(data)
    letters = []
    for i in range(8):
        group = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(group, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*letters)


def records(pages: DataFrame) -> DataFrame:
    """One text column: the WARC record of each page, without the final \\r\\n\\r\\n."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.encode("payload", "UTF-8"))).withColumn("n", F.octet_length("payload"))
    # a payload is known by digest and length
    # staged, so that the join has plain exchanges on both sides and Spark can split a payload of very many pages
    first = stage(rows.groupBy("digest", "n").agg(F.max("page_id").alias("kept")), "payloads")
    rows = rows.join(first, ["digest", "n"])
    is_response = F.col("kept").isNull() | F.col("page_id").eqNullSafe(F.col("kept"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    block = F.concat(head, F.when(is_response, F.col("payload")).otherwise(""))
    captured = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    heads = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        header("WARC-Type", F.when(is_response, "response").otherwise("revisit")),
        header("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")))),
        header("WARC-Date", captured),
        header("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(~is_response, header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.when(~is_response, header("WARC-Refers-To", urn(F.col("kept")))),
        header("Content-Type", F.lit("application/http;msgtype=response")),
        header("Content-Length", F.col("_bytes").cast("string")),
    )
    return rows.withColumn("_block", block).withColumn("_bytes", F.octet_length("_block")).select(F.concat(heads, F.lit(CRLF * 2), F.col("_block")).alias("value"))


def members(record: bytes) -> Iterator[bytes]:
    """A record as gzip members, one for all but the longest records."""
    for i in range(0, len(record), MEMBER_BYTES):
        press = zlib.compressobj(5, zlib.DEFLATED, 31)
        yield press.compress(record[i : i + MEMBER_BYTES]) + press.flush()


def write(pages: DataFrame, path: str) -> None:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])

        for batch in batches:
            for record in batch.column(0):
                for member in members(record.as_py().encode("utf-8", "surrogatepass") + b"\r\n\r\n"):
                    held.append(member)
                    size += len(member)
                if size >= FILE_BYTES:
                    yield file()
                    held, size = [], 0
        if held:
            yield file()

    files = records(pages).mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def unpack(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Where each gzip member of a file begins, and what it holds."""
    view, at, step = memoryview(content), 0, 1 << 15
    while at < len(view):
        press, out, end = zlib.decompressobj(31), [], at
        while not press.eof:
            if end >= len(view):
                raise ValueError(f"the member at {at} breaks off")
            out.append(press.decompress(view[end : end + step]))
            end = min(end + step, len(view))
        yield at, b"".join(out)
        at = end - len(press.unused_data)


def archived(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(where its member begins, headers, block) of each record of a compressed archive."""
    held, begin = b"", 0
    for at, data in unpack(content):
        begin = begin if held else at
        held += data
        if held.endswith(b"\r\n\r\n"):
            head, _, rest = held.partition(b"\r\n\r\n")
            size = next(int(line[15:]) for line in head.lower().split(b"\r\n") if line.startswith(b"content-length:"))
            if len(rest) >= size + 4:
                yield from ((begin, headers, block) for _, headers, block in parse(io.BytesIO(held)))
                held = b""
    if held:
        raise ValueError(f"the record at {begin} breaks off")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers with lower-case names, block) of each record of an uncompressed archive."""
    at = 0
    while line := stream.readline():
        start, size = at, len(line)
        if not line.strip():
            at += size
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            size += len(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        at += size + len(line) + len(block)
        yield start, headers, block


def url_key(url: str) -> str:
    """Sort-friendly key: host labels from the right, then path and query."""
    _, sep, rest = url.partition("://")
    if not sep:
        return url.lower()
    host, slash, path = rest.partition("/")
    return f"{','.join(reversed(host.lower().split('.')))}){slash}{path.lower()}"


def _urn(value: str) -> int | None:
    return int(value[len("<urn:page:") : -1]) if value.startswith("<urn:page:") else None


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of every archive file below path, sorted within their file."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                for at, headers, block in archived(content):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response":
                        size, own = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if own != digest:
                            raise ValueError(f"{name}: the record at {at} has digest {own}, not {digest}")
                    else:
                        size = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                    captured = int(datetime.strptime(headers["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
                    rows.append((url_key(headers.get("warc-target-uri", "")), captured, _urn(headers["warc-record-id"]), size, digest, kind, _urn(headers.get("warc-refers-to", "")), at))
                rows.sort(key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2]))
                out = pd.DataFrame(rows, columns=["urlkey", "captured", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "at"])
                out.insert(0, "seq", range(len(out)))
                out.insert(0, "run", name)
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return files.select("path", "content").mapInPandas(read, RUN)


class LoserTree:
    """K-way merge of sorted lists: the winner leaves, and only its path to the root is replayed."""

    def __init__(self, lists: list[list]):
        self.lists, self.k = lists, max(1, len(lists))
        self.at = [0] * self.k
        self.tree = [-1] * self.k  # losers; tree[0] is the winner
        for leaf in range(self.k - 1, -1, -1):
            self._replay(leaf)

    def _beats(self, a: int, b: int) -> bool:
        """Whether list a's head goes before list b's; ended lists lose, ties go by list."""
        if a >= len(self.lists) or self.at[a] >= len(self.lists[a]):
            return False
        if self.at[b] >= len(self.lists[b]):
            return True
        x, y = self.lists[a][self.at[a]], self.lists[b][self.at[b]]
        return x < y or (x == y and a < b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:  # still being built: wait here for the other side
                self.tree[node] = winner
                return
            if self._beats(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.lists:
            w = self.tree[0]
            if self.at[w] >= len(self.lists[w]):
                return
            yield self.lists[w][self.at[w]]
            self.at[w] += 1
            self._replay(w)


def merge(captures: DataFrame, partitions: int | None = None) -> DataFrame:
    """All captures in order of URL key, time and page, by range. captures are read twice (the ranges come from a sample)."""
    n = partitions or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a range's captures are index entries of a few hundred bytes, a shuffle partition of them fits a task
        held = [f for f in frames if len(f)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        ids = rows["page_id"].fillna(-1).astype("int64")
        keys = list(zip(rows["urlkey"], rows["captured"], ids, rows.index, strict=True))
        lists = [keys[g[0] : g[-1] + 1] for g in (list(x) for x in rows.groupby("run", sort=False).indices.values())]
        order = [key[3] for key in LoserTree(lists)]
        for i in range(0, len(order), 10_000):
            yield rows.iloc[order[i : i + 10_000]].astype({"page_id": "Int64", "refers_to": "Int64"})

    dealt = captures.repartitionByRange(n, "urlkey", "captured", "page_id").sortWithinPartitions("run", "seq")
    return dealt.mapInPandas(merged, RUN)


def archive_and_index(pages: DataFrame) -> DataFrame:
    """Write the pages' archives to the shared folder, read them back and return the ordered capture history."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path)
    return merge(stage(runs(spark, path), "captures"))
