"""How far the sources of a language differ in their words: counted by length-bucketed packing.

A term is a run of ASCII letters and non-ASCII characters, with A-Z lower-cased. A task takes the UTF-8 bytes of a few megabytes of
texts and cuts them by a table of byte classes. Terms of up to 8 bytes become one uint64 word, those of up to 16 bytes two; the words
are radix-sorted 16 bits a pass and their runs counted. Longer terms lie in a bucket for each length, whose rows are sorted as bytes.
No term holds the byte 0, so that words and rows padded with it stay distinct. Spark adds the counts of the tasks up.

Results for odd input. Null text, language or source: the empty string. Empty texts: no term, but their group takes part. A repeated
row is a document again. A group without kept terms has the same share for each term; a language without any has pairs of value 0 and no
terms. A source alone in its language has no pair. Texts of any length are cut whole; one text must fit into a task's memory. Columns
other than the three named ones are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Bytes of text that are cut and sorted at a time.
SLICE = 8 << 20
#: Sources whose pairs are summed together in a task: 512 KB of sums.
BLOCK = 256
#: For each byte: what it is in a term, 0 where it ends one.
LETTER = np.zeros(256, np.uint8)
LETTER[0x80:] = np.arange(0x80, 0x100)
LETTER[ord("a") : ord("z") + 1] = LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
#: For each number of bytes: the mask that keeps so many of a big-endian word.
FIRST_BYTES = np.array([0] + [(0xFFFFFFFFFFFFFFFF << (64 - 8 * n)) & 0xFFFFFFFFFFFFFFFF for n in range(1, 9)], np.uint64)


def radix_order(words: list[np.ndarray], group: np.ndarray) -> np.ndarray:
    """The order by words (the first counts most), then by group, then as given: a stable pass for each 16 bits that differ at all."""
    order = np.arange(len(group))
    for key in (group.astype(np.uint64), *reversed(words)):
        for shift in (0, 16, 32, 48):
            digit = ((key >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]  # numpy sorts 16-bit keys by radix
    return order


def runs(differs: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted terms: where a run of one term and group starts, its length, its number of documents. differs: from the term before."""
    new = np.ones(len(group), bool)
    new[1:] = differs | (group[1:] != group[:-1])
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    heads = np.flatnonzero(new)
    return heads, np.diff(np.append(heads, len(group))), np.add.reduceat(other.astype(np.int64), heads)


def _strings(rows: np.ndarray) -> pa.Array:
    """Rows of bytes, padded with 0, as strings."""
    real = rows != 0
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum(real.sum(axis=1), out=ends[1:])
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows[real])))


def counted(texts: pa.Array, group: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """For some texts and their groups: group, term, occurrences and documents of each run, a bucket of lengths at a time."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    if not len(texts) or offsets[-1] == offsets[0] or data is None:
        return
    low = LETTER[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    inside, edge = low != 0, np.zeros(len(low) + 1, bool)
    edge[offsets] = True  # a term ends with its text
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
    length = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1 - starts
    if not len(starts):
        return
    doc = np.searchsorted(offsets, starts, side="right") - 1
    low = np.append(low, np.zeros(16, np.uint8))
    word_at = np.lib.stride_tricks.sliding_window_view(low, 8)
    for least, most in ((1, 8), (9, 16)):
        which = np.flatnonzero((length >= least) & (length <= most))
        if len(which):
            words = [word_at[starts[which] + at].view(">u8").ravel().astype(np.uint64) for at in range(0, most, 8)]
            words[-1] &= FIRST_BYTES[length[which] - least + 1]
            of, own = group[doc[which]], doc[which]
            order = radix_order(words, of)
            words, of, own = [w[order] for w in words], of[order], own[order]
            heads, n, docs = runs(np.logical_or.reduce([w[1:] != w[:-1] for w in words]), of, own)
            yield of[heads], _strings(np.stack([w[heads] for w in words], axis=1).astype(">u8").view(np.uint8).reshape(len(heads), -1)), n, docs
    for size in np.unique(length[length > 16]):
        which = np.flatnonzero(length == size)
        rows = np.lib.stride_tricks.sliding_window_view(low, size)[starts[which]]
        of, own = group[doc[which]], doc[which]
        by_group = np.argsort(of, kind="stable")
        order = by_group[np.argsort(rows.view(f"S{size}").ravel()[by_group], kind="stable")]
        rows, of, own = rows[order], of[order], own[order]
        heads, n, docs = runs((rows[1:] != rows[:-1]).any(axis=1), of, own)
        yield of[heads], _strings(rows[heads]), n, docs


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of SLICE bytes in all, or one longer text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
        yield at, to
        at = to


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        both = langs.indices.to_numpy().astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy()
        names, code = np.unique(both, return_inverse=True)
        for at, to in _slices(batch.column(2)):
            for group, terms, n, docs in counted(batch.column(2).slice(at, to - at), code[at:to]):
                lang, source = np.divmod(names[group], max(1, len(sources.dictionary)))
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), terms, pa.array(n.astype(np.int64)), pa.array(docs)],
                    ["lang", "source", "term", "n", "docs"],
                )


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, its occurrences n and documents docs."""
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = read.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column, scale: int, prior: int) -> Column:
    """1 + floor(scale * (n + prior) / (total + prior * terms)), exact at any size of the counts."""
    top = (n + prior).cast("decimal(19,0)") * F.lit(scale).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", top, (total + prior * terms).cast("decimal(19,0)"))


def _dense(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of a new matrix."""
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def _pair_sums(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """lang, a, b and what the rows of this task add to the pair's value; rows come sorted by lang and blocks of sources."""
    key, sums = None, None

    def flush() -> pa.RecordBatch:
        lang, a, b = key
        left, right = np.nonzero(np.triu(np.ones(sums.shape, bool), 1) if a == b else np.ones(sums.shape, bool))
        found = [pa.array([lang] * len(left), pa.string()), pa.array(left + a * block), pa.array(right + b * block), pa.array(sums[left, right])]
        return pa.RecordBatch.from_arrays(found, ["lang", "a", "b", "value"])

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "a", "b")), strict=True))
        edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for i, j in zip(edges, edges[1:], strict=False):
            if i == j:
                continue
            left, right = (_dense(batch.column(c).slice(i, j - i)) for c in ("left", "right"))
            if keys[i] != key:
                if key is not None:
                    yield flush()
                key, sums = keys[i], np.zeros((left.shape[1], right.shape[1]), np.int64)
            shares = batch.column("shares").slice(i, j - i)
            row = np.repeat(np.arange(j - i), np.diff(shares.offsets.to_numpy()))
            at, p = (shares.flatten().field(c).to_numpy() for c in ("i", "p"))
            for side, number in ((left, key[1]), (right, key[2])):
                own = at // block == number
                side[row[own], at[own] % block] = p[own]
            for k in range(left.shape[1]):
                sums[k] += np.abs(right - left[:, [k]]).sum(axis=0)
    if key is not None:
        yield flush()


def _pairs(known: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """lang, a, b (numbers of sources) and the sum of |p - q| over the kept terms, for a below b."""
    blocks = groups.groupBy("lang", (F.col("i") / block).cast("long").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "base"))), lambda e: e["base"]).alias("bases"))
    blocks = blocks.join(groups.groupBy("lang").agg((F.max("i") / block).cast("long").alias("last")), "lang")
    left = blocks.select("lang", F.col("block").alias("a"), F.col("bases").alias("left"), F.explode(F.sequence("block", "last")).alias("b"))
    both = left.join(blocks.select("lang", F.col("block").alias("b"), F.col("bases").alias("right")), ["lang", "b"])
    # a row for each term and two blocks that hold a source with it; the rows without a term put every pair there
    spread = known.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).withColumn("block", (F.col("i") / block).cast("long"))
    rows = spread.groupBy("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "term").agg(F.collect_list(F.struct("i", "p")).alias("shares"))
    rows = rows.join(both, ["lang", "a", "b"]).select("lang", "a", "b", "left", "right", "shares")
    zero = lambda c: F.transform(c, lambda _: F.lit(0).cast("long")).alias(c)
    seeds = both.select("lang", "a", "b", zero("left"), zero("right"), F.array().cast("array<struct<i:long,p:long>>").alias("shares"))
    found = rows.unionByName(seeds).sortWithinPartitions("lang", "a", "b").mapInArrow(lambda batches: _pair_sums(batches, block), "lang string, a long, b long, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = 30, scale: int = 1_000_000_000, prior: int = 5, top: int = 50, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source is from the others of its language, and by which terms.

    A language keeps the terms of at least min_docs of its documents. A group's share of a term is 1 + floor(scale * (count + prior) /
    (all + prior * terms)). Part "pair" has for each other source the sum of the shares' distances; part "term" the top terms whose share
    is above the language's.
    """
    counts = stage(term_counts(docs), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("everywhere"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    known = stage(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "everywhere"), "known")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    all_groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    of_lang = known.groupBy("lang", "term").agg(F.first("everywhere").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    groups = all_groups.join(known.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", zero("total"), zero("lang_total"), zero("terms"), (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("i"))
    no_terms = F.when(F.col("terms") == 0, F.lit(0).cast("long"))
    base = no_terms.otherwise(share(F.lit(0).cast("long"), F.col("total"), F.greatest("terms", F.lit(1)), scale, prior)).alias("base")
    groups = stage(groups.select("*", base, (F.max("i").over(Window.partitionBy("lang")) / block).cast("long").alias("last")), "groups")
    p = share(F.col("n"), F.col("total"), F.col("terms"), scale, prior)
    q = share(F.col("everywhere"), F.col("lang_total"), F.col("terms"), scale, prior)
    shares = known.join(groups, ["lang", "source"]).select("lang", "source", "i", "last", "term", p.alias("p"), q.alias("q"))
    named = groups.select("lang", "i", "source")
    pairs = _pairs(shares.select("lang", "i", "last", "term", "p"), groups.select("lang", "i", "base"), block)
    pairs = pairs.join(named.withColumnsRenamed({"i": "a", "source": "one"}), ["lang", "a"]).join(named.withColumnsRenamed({"i": "b", "source": "two"}), ["lang", "b"])
    ways = F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))
    pairs = pairs.select("lang", F.explode(ways).alias("way"), "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", place).unionByName(terms.select("*", place).where(F.col("rank") <= top))
