"""SimHash near-duplicates by anchor-point covering.

A fingerprint is split into two halves of 32 bits: two fingerprints with at most 3 differing bits agree in one half but for one
bit at most. The anchors of a half are the code words of the [31, 26] Hamming code beside one free bit, a covering code of
radius 1. A fingerprint is at home at its nearest anchor and replicated to every anchor within radius plus threshold, 1 + 1
bits; so at the home anchor of either of two linked fingerprints both are present. Equal fingerprints are merged before, each
anchor's fingerprints are compared in one task, and only spanning links leave it; groups too large to compare all with all are
compared by equal bytes of the other half, of which 3 differing bits leave one alone.

Defined results: null and empty texts have fingerprint zero and link like any other; rows with a null doc_id link like any other,
may so connect documents that are further apart, and get the smallest doc_id that they reach (null if there is none); repeated rows
share their fingerprint; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, stage
from .common import words as words_of
from .components import components

SHINGLE, SEED, BITS = 3, 42, 3
#: Fingerprints of an anchor that are compared all with all; above, by equal bytes.
ALL_PAIRS = 2_000


def text_hashes(text: str | None) -> np.ndarray:
    """XXH64 of a text's shingles, repeats included; fewer words than a shingle: of the whole sequence."""
    words = words_of((text or "").translate(ASCII_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    data = " ".join(words).encode()
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(data, SEED)], np.uint64)
    # byte offsets of the words' starts in the joined text; a shingle ends before the space in front of the word that follows
    starts = np.concatenate(([0], np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1, [len(data) + 1]))
    digest, begin, end = xxhash.xxh64_intdigest, starts[:-SHINGLE].tolist(), (starts[SHINGLE:] - 1).tolist()
    return np.fromiter((digest(data[a:b], SEED) for a, b in zip(begin, end, strict=True)), np.uint64, len(end))


def fingerprint(text: str | None) -> int:
    """Bit i is 1 if set in over half the hashes."""
    hashes = text_hashes(text)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp (the fingerprint as a signed long) and mark (a hash of the text, null of none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), batch.column(2)], ["k", "fp", "mark"])

    return docs.select(key, text, mark(F.col(text))).mapInArrow(run, f"k {dict(docs.dtypes)[key]}, fp long, mark long").withColumnRenamed("k", key)


def mark(text: Column) -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("mark")


def nearest(half: np.ndarray) -> np.ndarray:
    """The code word nearest to each 32-bit value: the Hamming syndrome over the low 31 bits names the bit to flip."""
    syndrome = np.zeros(half.shape, np.uint32)
    for bit in range(31):
        syndrome ^= ((half >> np.uint32(bit)) & np.uint32(1)) * np.uint32(bit + 1)
    flip = np.where(syndrome > 0, np.uint32(1) << ((syndrome + np.uint32(31)) % np.uint32(32)), np.uint32(0))
    return half ^ flip.astype(np.uint32)


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor with the half's number above, whether at home) for every anchor that a fingerprint goes to."""
    rows, keys, homes = [], [], []
    for number in range(2):
        half = (prints >> np.uint64(32 * number)).astype(np.uint32)
        home = nearest(half)
        # the anchors within two bits are the homes of the points within one bit
        near = np.stack([home] + [nearest(half ^ np.uint32(1 << bit)) for bit in range(32)], axis=1)
        near.sort(axis=1)
        first = np.ones(near.shape, bool)
        first[:, 1:] = near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(first)
        rows.append(row)
        keys.append(near[row, col].astype(np.int64) | np.int64(number << 32))
        homes.append(near[row, col] == home[row])
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _linked(prints: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[at] ^ prints[to]) <= BITS


def _group_links(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the fingerprints of one anchor, as positions."""
    n, found = len(prints), []
    if n <= ALL_PAIRS:
        groups = [np.arange(n)]
    else:
        groups = []
        for byte in range(8):
            value = (prints >> np.uint64(8 * byte)) & np.uint64(255)
            order = np.argsort(value, kind="stable")
            groups += np.split(order, np.flatnonzero(np.diff(value[order])) + 1)
    for group in groups:
        own = prints[group]
        label = np.arange(len(group))
        for i in range(len(group) - 1):
            near = np.flatnonzero(np.bitwise_count(own[i + 1 :] ^ own[i]) <= BITS) + i + 1
            fresh = near[label[near] != label[i]]
            if len(fresh):
                joined, one = np.unique(label[fresh], return_index=True)
                found += [(group[i], group[j]) for j in fresh[one]]
                label[np.isin(label, joined)] = label[i]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def links(prints: DataFrame) -> DataFrame:
    """prints: distinct fp with its node. Returns links a, b between nodes whose fingerprints differ in 1 to BITS bits."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 5_000):
                part = batch.slice(i, 5_000)
                values, nodes = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                row, key, home = anchors(values.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(values[row]), pa.array(nodes[row]), pa.array(home)], ["anchor", "fp", "node", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(pairs_a: list, pairs_b: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(pairs_a)), pa.array(np.concatenate(pairs_b))], ["a", "b"])

        def settle(key: np.ndarray, value: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            """Links in rows sorted by anchor, all rows of an anchor present."""
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            value = value.view(np.uint64)  # bits of signed numbers count by magnitude
            begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.append(begins, len(key)))
            small = np.repeat(sizes <= 32, sizes)
            for shift in range(1, 32):  # all pairs of small groups, by distance in the order
                at = np.flatnonzero((key[shift:] == key[:-shift]) & small[shift:])
                if not len(at):
                    break
                at = at[_linked(value, at, at + shift)]
                a.append(node[at])
                b.append(node[at + shift])
            for g in np.flatnonzero(sizes > 32):
                own = slice(begins[g], begins[g] + sizes[g])
                x, y = _group_links(value[own])
                a.append(node[own][x])
                b.append(node[own][y])
            return told(a, b)

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            key = columns[0]
            last = int(np.searchsorted(key, key[-1]))  # the last anchor may go on in the next batch
            if last or (held and held[-1][0][-1] != key[0]):
                if not last:  # one new anchor: what was held is whole
                    yield settle(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held = [columns]
                    continue
                held.append(tuple(c[:last] for c in columns))
                yield settle(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held = [tuple(c[last:] for c in columns)]
            else:
                held.append(columns)
        if held:
            yield settle(*(np.concatenate(c) for c in zip(*held, strict=True)))

    dealt = prints.select("fp", "node").mapInArrow(spread, "anchor long, fp long, node long, home boolean")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.select("anchor", "fp", "node").repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long")


def classes(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """fp and component_id: the smallest key of the rows whose fingerprints are reachable over links."""
    nodes = prints.groupBy("fp").agg(F.min(key).alias("least"))
    # a fingerprint is its own node, so that those without a key link too
    found = components(links(nodes.select("fp", F.col("fp").alias("node"))))
    # staged, as the joins of components are: a component of very many fingerprints can be split
    placed = stage(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "placed")
    named = stage(placed.groupBy("component").agg(F.min("least").alias("component_id")), "named")
    return stage(placed.join(named, "component").select("fp", "component_id"), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id: the smallest doc_id reachable over links."""
    prints = stage(fingerprints(docs).drop("mark"), "simhash")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(classes(prints), "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def firsts(docs: DataFrame) -> DataFrame:
    """doc_id and mark of one text of each component: of the smallest doc_id; where it has several, that with the smallest mark."""
    prints = stage(fingerprints(docs), "simhash")
    own = prints.join(classes(prints), "fp").where("doc_id = component_id")
    return own.groupBy("doc_id").agg(F.min("mark").alias("mark"), F.count(F.lit(1)).alias("rows"))
