"""Substring deduplication with a compressed FM-index per shard.

A word goes when a window of WINDOW words covers it whose word sequence starts earlier too: in a smaller doc_id, or earlier in
the same document.

1. Every window is keyed by the least hash of its SEED-word runs (its minimizer); equal windows have equal keys. Neighbouring
   windows that share the same run make one segment, an eighth as many rows as there are words.
2. Keys that one segment alone has are done: none of its windows occurs twice. Counts are pre-aggregated.
3. The other segments are dealt by key to shards of about SHARD segments. Equal segments of one batch of documents are merged
   before, and all but the earliest are repeats: a passage of very many documents weighs as much as one a batch. Segments under
   keys with over HEAVY segments are cut into single windows, dealt by their own hash, so that such a passage spreads.
4. A shard lays out its segments in document order (of equal ones the first two) and indexes them: the Burrows-Wheeler transform
   in a wavelet matrix of packed bits, and every SAMPLE-th place of a segment. The segments stream through it: backward search
   gives the matching statistics, the longest match that ends at a word and occurs twice or more, from the last word of a segment
   that has an equal one, and from every window's end of one that shares its key with a different one (a window of any other can
   stand nowhere else). Where a match reaches WINDOW words, its interval of suffixes is located by walking to the sampled places,
   and all but the earliest are repeats, reported as intervals of windows.
5. The repeats go back to their documents.

Every window is looked at; no key, segment or document is dropped. The documents' text is shuffled once (both joins read the
same exchange).

Defined results: null and empty texts have no words; texts under WINDOW words keep all; a null doc_id counts as the smallest;
rows with the same doc_id and different texts are documents of their own, in the order of a text hash; rows that repeat doc_id
and text are one document and get the same result each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .common import words as words_of

WINDOW, SEED = 20, 6
HEAVY, SHARD, SAMPLE = 5_000, 100_000, 8
CACHE = 500_000
NULL_ID = -(2**63)
PACKED = "shard int, keys array<long>, docs array<long>, subs array<long>, starts array<int>, counts array<int>, texts array<int>, words binary"


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 1)
        return value


def segments(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first window and number of windows of the segments of a text, given its words' hashes."""
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs = len(hashes) - SEED + 1
    value = np.zeros(runs, np.uint64)
    for j in range(SEED):
        value *= np.uint64(0x9E3779B97F4A7C15)
        value += hashes[j : j + runs]
    value ^= value >> np.uint64(31)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(29)
    # the least value of each window's runs, the last of equals: by doubling the reach
    reach, span, at = 1, WINDOW - SEED + 1, np.arange(runs)
    while reach < span:
        step = min(reach, span - reach)
        left, right = value[:-step], value[step:]
        later = right <= left
        at = np.where(later, at[step:], at[:-step])
        value = np.where(later, right, left)
        reach += step
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return value[first], first, np.diff(np.append(first, n))


class FMIndex:
    """FM-index of segments laid one after the other, each ended by a 0. Tokens are 0 (never searched) to size - 1."""

    def __init__(self, tokens: np.ndarray, size: int):
        n = len(tokens)
        # separators sort below all tokens and by place, so that all suffixes differ after a segment's length
        order = tokens.astype(np.int64) + n
        gaps = tokens == 0
        order[gaps] = np.arange(int(gaps.sum()))
        rank = np.unique(order, return_inverse=True)[1].astype(np.int64)
        width, step = 1, 3 if n < 1 << 21 else 2  # ranks that fit a key beside each other
        bits = 63 // step
        while True:
            key = rank << bits * (step - 1)
            for k in range(1, step):
                key[: n - k * width] |= (rank[k * width :] + 1) << bits * (step - 1 - k)
            suffixes = np.argsort(key)
            fresh = np.diff(key[suffixes]) != 0
            rank[suffixes] = np.concatenate(([0], np.cumsum(fresh)))
            width *= step
            if fresh.all() or width >= n:
                break
        self.n = n
        last = tokens[suffixes - 1]  # the Burrows-Wheeler transform
        self.before = np.concatenate(([0], np.cumsum(np.bincount(tokens, minlength=size))))
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.sums, self.zeros = [], [], []
        current, begin = last.astype(np.int64), np.zeros(size, np.int64)
        symbols = np.arange(size)
        for level in range(self.levels):
            bit = (current >> (self.levels - 1 - level)) & 1
            words, sums = self._packed(bit)
            self.bits.append(words)
            self.sums.append(sums)
            self.zeros.append(n - int(bit.sum()))
            begin = self._down(level, symbols, begin)
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        self.begin = begin
        # every SAMPLE-th place of a segment is kept, its first one too: a walk never leaves its segment
        ends = np.flatnonzero(gaps)
        first = np.concatenate(([0], ends + 1))[np.cumsum(gaps) - gaps]
        held = ((np.arange(n) - first) % SAMPLE == 0)[suffixes]
        self.held, self.held_sums = self._packed(held)
        self.places = suffixes[held].astype(np.int32 if n < 2**31 else np.int64)

    @staticmethod
    def _packed(bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits in words of 64, and how many ones stand before each word."""
        padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
        padded[: len(bit)] = bit
        words = np.packbits(padded, bitorder="little").view("<u8")
        return words, np.concatenate(([0], np.cumsum(np.bitwise_count(words)))).astype(np.int64)

    @staticmethod
    def _ones(words: np.ndarray, sums: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, low = at >> 6, (at & 63).astype(np.uint64)
        return sums[word] + np.bitwise_count(words[word] & ((np.uint64(1) << low) - np.uint64(1)))

    @staticmethod
    def _bit(words: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0

    def _down(self, level: int, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        ones = self._ones(self.bits[level], self.sums[level], at)
        return np.where((symbol >> (self.levels - 1 - level)) & 1, self.zeros[level] + ones, at - ones)

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One backward step of bounds: the first suffix in front of which symbol stands, at or after each bound."""
        rank = at
        for level in range(self.levels):
            rank = self._down(level, symbol, rank)
        return self.before[symbol] + rank - self.begin[symbol]

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Where the suffixes of rows begin: back through the text to the next kept place."""
        out, steps, which = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        while len(which):
            kept = self._bit(self.held, row)
            out[which[kept]] = self.places[self._ones(self.held, self.held_sums, row[kept])] + steps
            which, row, steps = which[~kept], row[~kept], steps + 1
            symbol, at = np.zeros(len(row), np.int64), row
            for level in range(self.levels):
                bit = self._bit(self.bits[level], at)
                ones = self._ones(self.bits[level], self.sums[level], at)
                at = np.where(bit, self.zeros[level] + ones, at - ones)
                symbol = symbol << 1 | bit
            row = self.before[symbol] + at - self.begin[symbol]
        return out

    def statistics(self, tokens: np.ndarray, ends: np.ndarray, longest: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a streamed text: of each end the length of the longest match, up to longest tokens back, that
        occurs twice or more, and the interval of suffixes of its last told tokens where it is that long (0, 0 elsewhere)."""
        length, first, last = (np.zeros(len(ends), np.int64) for _ in range(3))
        which, low, high, depth = np.arange(len(ends)), np.zeros(len(ends), np.int64), np.full(len(ends), self.n), 0
        while len(which):
            symbol = tokens[ends[which] - depth]
            low, high, depth = self.step(symbol, low), self.step(symbol, high), depth + 1
            alive = high - low >= 2
            which, low, high = which[alive], low[alive], high[alive]
            length[which] = depth
            there = told[which] == depth
            first[which[there]], last[which[there]] = low[there], high[there]
            on = longest[which] > depth
            which, low, high = which[on], low[on], high[on]
        return length, first, last

    def earliest(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of intervals of suffixes, equal or apart: where the earliest of each begins. Each interval is located once."""
        low, index = np.unique(first, return_inverse=True)
        size = np.zeros(len(low), np.int64)
        size[index] = last - first
        begin = np.cumsum(size) - size
        rows = np.repeat(low - begin, size) + np.arange(int(size.sum()))
        return np.minimum.reduceat(self.locate(rows), begin)[index] if len(low) else low


def _repeats(keys: np.ndarray, place: list[tuple[int, int, int]], counts: np.ndarray, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """(doc, sub, first window, windows) of the repeats of a shard."""
    same: dict[str, list[int]] = {}
    for i in sorted(range(len(texts)), key=place.__getitem__):
        same.setdefault(texts[i], []).append(i)
    first = np.array([own[0] for own in same.values()], np.int64)
    many = np.unique(keys[first], return_counts=True)
    doubted = set(first[np.isin(keys[first], many[0][many[1] > 1])].tolist())
    # copies of a segment stand in the index twice: the earliest, and the next for all that follow
    laid = sorted([*doubted, *(i for own in same.values() if len(own) > 1 for i in own[:2])], key=place.__getitem__)
    laid = list(dict.fromkeys(laid))
    if not laid:
        return
    size = counts[laid].astype(np.int64) + WINDOW  # its words and the separator
    begin = np.cumsum(size) - size
    numbers, names = pd.factorize(np.array(" ".join([texts[i] for i in laid]).split(" "), dtype=object))
    tokens = np.zeros(int(size.sum()), np.int64)
    word = np.ones(len(tokens), bool)
    word[begin + size - 1] = False
    tokens[word] = numbers + 1
    at = dict(zip(laid, range(len(laid)), strict=True))
    index = FMIndex(tokens, len(names) + 1)
    # a copy's longest match, from its last word, is the whole segment
    copies = [own for own in same.values() if len(own) > 1]
    where = np.array([at[own[1]] for own in copies], np.int64)
    for i in range(0, len(where), 200_000):
        part = where[i : i + 200_000]
        length, low, high = index.statistics(tokens, begin[part] + size[part] - 2, size[part] - 1, size[part] - 1)
        hit = np.flatnonzero(length == size[part] - 1)
        for k in hit[index.earliest(low[hit], high[hit]) != begin[part[hit]]].tolist():
            for j in copies[i + k][1:]:
                yield (*place[j], int(counts[j]))
    # of the others every window's end
    searched = np.array([i for i in laid if i in doubted], np.int64)
    spot = np.array([at[i] for i in searched.tolist()], np.int64)
    count = counts[searched]
    owner = np.repeat(np.arange(len(searched)), count)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    again = np.zeros(len(owner), bool)
    for i in range(0, len(owner), 200_000):
        part = slice(i, i + 200_000)
        start = begin[spot[owner[part]]] + window[part]
        length, low, high = index.statistics(tokens, start + WINDOW - 1, window[part] + WINDOW, np.full(len(start), WINDOW))
        hit = np.flatnonzero(length >= WINDOW)
        again[i + hit] = index.earliest(low[hit], high[hit]) != start[hit]
    # windows in a row make one interval
    starts = np.flatnonzero(again & ~(np.concatenate(([False], again[:-1])) & (window > 0)))
    ends = np.flatnonzero(again & ~(np.concatenate((again[1:], [False])) & (np.append(window[1:], 0) > 0)))
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        doc, sub, start = place[searched[owner[a]]]
        yield doc, sub, start + int(window[a]), b - a + 1


def text_order(text: Column) -> Column:
    """A number for a text: sixty bits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def documents(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc, sub and text, and the columns that name a document: sub sets apart different texts of one doc_id, if there are any."""
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), text_order(F.col("text")).alias("sub"), "text")
    doubled = named.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if doubled.isEmpty():
        return named.select("doc", F.lit(0).cast("long").alias("sub"), "text"), ["doc"]
    return named, ["doc", "sub"]


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    rows, names = documents(docs)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            for i in range(0, batch.num_rows, 1_000):
                part = batch.slice(i, 1_000)
                found = []
                for text in part.column(2).to_pylist():
                    words = words_of(text)
                    found.append(segments(np.fromiter(map(known.__getitem__, words), np.uint64, len(words))))
                row = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                columns = [pa.array(np.concatenate([f[0] for f in found]).view(np.int64)), part.column(0).take(row), part.column(1).take(row)]
                columns += [pa.array(np.concatenate([f[k] for f in found]).astype(np.int32)) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "doc", "sub", "start", "count"])

    found = stage(rows.mapInArrow(key, "key long, doc long, sub long, start int, count int"), "segments")
    # staged, so that the join has plain exchanges on both sides and Spark can split a frequent key
    often = stage(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    shared = found.join(often, "key").groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("start", "count", "key", (F.col("n") > HEAVY).alias("heavy")))).alias("segments"))
    # shards follow the data: merged segments are fewer
    shards = max(64, -(-(often.agg(F.sum("n")).first()[0] or 0) // SHARD))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        turn = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 2_000):
                part = batch.slice(i, 2_000)
                held: dict[str, tuple] = {}  # text -> earliest place
                gone: list[tuple] = []

                def add(text: str, key: int, place: tuple, held: dict = held, gone: list = gone) -> None:
                    other = held.setdefault(text, (place, key))
                    if other[0] != place:
                        if place < other[0]:
                            held[text], place = (place, key), other[0]
                        gone.append(place)

                for doc, sub, text, own in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                    words = words_of(text)
                    for s in own:
                        start, count = s["start"], s["count"]
                        if not s["heavy"]:
                            add(" ".join(words[start : start + count + WINDOW - 1]), s["key"], (doc, sub, start, count))
                            continue
                        for k in range(start, start + count):
                            window = " ".join(words[k : k + WINDOW])
                            add(window, xxhash.xxh64_intdigest(window.encode("utf-8", "surrogatepass"), 3) - 2**63, (doc, sub, k, 1))
                dealt: dict[int, list] = {}
                for text, (place, key) in held.items():
                    dealt.setdefault((key ^ (key >> 32)) % shards, []).append((key, *place, text))
                for place in gone:
                    turn += 1
                    dealt.setdefault(turn % shards, []).append((0, *place, None))
                out = []
                for shard, own in dealt.items():
                    texts = [o[5] for o in own if o[5] is not None]
                    number = iter(range(len(texts)))
                    out.append((shard, *([o[k] for o in own] for k in range(5)), [-1 if o[5] is None else next(number) for o in own], press.compress("\n".join(texts).encode("utf-8", "surrogatepass"))))
                types = [pa.int32(), *[pa.list_(pa.int64())] * 3, *[pa.list_(pa.int32())] * 3, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], ["shard", "keys", "docs", "subs", "starts", "counts", "texts", "words"])

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        press, repeats, keys, place, counts, texts = zstandard.ZstdDecompressor(), [], [], [], [], []
        for row in group.itertuples(index=False):
            own = press.decompress(row.words).decode("utf-8", "surrogatepass").split("\n")
            for k, d, s, at, n, t in zip(row.keys, row.docs, row.subs, row.starts, row.counts, row.texts, strict=True):
                if t < 0:
                    repeats.append((d, s, at, n))
                else:
                    keys.append(k)
                    place.append((d, s, at))
                    counts.append(n)
                    texts.append(own[t])
        repeats += _repeats(np.array(keys, np.int64), place, np.array(counts, np.int64), texts)
        return pd.DataFrame(repeats, columns=["doc", "sub", "start", "count"]).astype({"doc": "int64", "sub": "int64", "start": "int32", "count": "int32"})

    packed = rows.join(shared.select(*names, "segments"), names).select("doc", "sub", "text", "segments").mapInArrow(pack, PACKED)
    removed = packed.groupBy("shard").applyInPandas(settle, "doc long, sub long, start int, count int")
    spans = removed.groupBy(*names).agg(F.collect_list(F.struct("start", "count")).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                out = []
                for text, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = words_of(text)
                    n = len(words)
                    if own:
                        edge = np.zeros(n + 1, np.int64)
                        for s in own:
                            edge[s["start"]] += 1
                            edge[s["start"] + s["count"] + WINDOW - 1] -= 1
                        words = [w for w, c in zip(words, np.cumsum(edge)[:n].tolist(), strict=True) if not c]
                    out.append((n, n - len(words), hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], ["doc", "n_words", "n_removed", "kept_sha256"])

    done = rows.join(spans, names, "left").select("doc", "text", "spans").mapInArrow(finish, "doc long, n_words long, n_removed long, kept_sha256 string")
    return done.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")
