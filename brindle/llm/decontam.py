"""Benchmark decontamination by CGK embedding and bit-sampling LSH, with exact edit verification.

Texts are compared as words, lower-cased and without punctuation. A document is contaminated by an item if some stretch of it is
within floor(MAX_EDITS * words of the item) word edits of the item: a similarity of 0.8 or more.

Windows start at local minima of a word hash (every STRIDE words in a row hold one), so item and copy start theirs at the same
words. From each start a CGK random walk reads the window: at step j it tells the word under its pointer and moves on by a
random bit that depends on j and the word, which turns few edits into few differing steps. Bit-sampling LSH keys a window by a
few sampled steps; TABLES keys of different depth, over WALKS walks, bring the recall that tests measure. A walk from a start near
the end of an item reads past it, which leaves items of under SHORT words too few starts: these are found by exact seeds instead.
An item that may have e edits is cut into e + 1 runs of words, one of which any copy within e edits holds unchanged.

Windows that share a key or a run with an item are cut to the item's size (with room for its edits), thinned by a bound on the words
they share with it, which never drops a match, and verified with the edit distance.

Items are taken in blocks of BLOCK, which are all that the driver or a task holds of them; each block is searched in all documents,
one after the other, and no block is left out.

Defined results: items with under MIN_WORDS words, null or empty ones are not searched; an item with a null id is searched, and told
with it; null and empty texts match nothing; items equal to each other each get their rows; repeated documents get a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .common import words as words_of

MAX_EDITS, MIN_WORDS = 0.2, 5
STRIDE, SHORT = 8, 15
#: Columns of the table of words that an item has.
SPREAD = 512
WALKS, STEPS = 2, 24
#: Of each walk's tables: how many steps they may sample, and how many they do.
TABLES = ((8, 5), (12, 5), (16, 6), (24, 6))
BLOCK = 20_000
CACHE = 300_000
SLOTS = 1 << 22


def normal(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalnum())


class _Vocabulary(dict):
    """Raw word -> number of its normal form in the items, 0: not there, -1: nothing but punctuation."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        form = normal(word)
        self[word] = number = self.known.get(form, 0) if form else -1
        return number


class Index:
    """The keys of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        forms = [(i, [w for w in map(normal, words_of(t)) if w]) for i, t in items]
        forms = [(i, w) for i, w in forms if len(w) >= MIN_WORDS]
        self.known = {w: n + 1 for n, w in enumerate(sorted({w for _, ws in forms for w in ws}))}
        self.items = [(i, np.array([self.known[w] for w in ws], np.int32)) for i, ws in forms]
        size = len(self.known) + 1
        self.hash = np.array([2**63] + [xxhash.xxh64_intdigest(w.encode(), 7) >> 1 for w in self.known], np.uint64)
        rng = np.random.default_rng(20_24)
        self.moves = rng.integers(0, 2, (WALKS, STEPS, size), dtype=np.int8)
        self.samples = [[np.sort(rng.choice(depth - 1, k - 1, replace=False)) + 1 for depth, k in TABLES] for _ in range(WALKS)]
        self.mixers = rng.integers(1, 2**63, (STEPS + 1), dtype=np.uint64) | np.uint64(1)
        self.sizes = np.array([len(w) for _, w in self.items], np.int64)
        self.has = np.zeros((len(self.items), SPREAD), bool)
        for row, (_, words) in enumerate(self.items):
            self.has[row, words % SPREAD] = True
        #: By length of their runs (0: CGK tables): which slots are used, sorted keys, items, and how far into the item they begin.
        self.tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        long = np.flatnonzero(self.sizes >= SHORT)
        if len(long):
            flat, begin = self.lay([self.items[i][1] for i in long])
            owner = np.repeat(long, self.sizes[long])
            offset = np.concatenate([np.arange(n) for n in self.sizes[long]])
            inside = np.repeat(begin, self.sizes[long]) + offset
            mine = np.isin(inside, self.starts(flat))
            for key in self.keys(flat, inside[mine]):
                self._add(0, key, owner[mine], offset[mine])
        runs: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero(self.sizes < SHORT).tolist():
            n = int(self.sizes[i])
            cuts = np.linspace(0, n, int(MAX_EDITS * n) + 2).astype(int).tolist()
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                runs.setdefault(hi - lo, []).append((i, lo))
        for size, own in sorted(runs.items()):
            key = np.concatenate([self.run_keys(self.items[i][1][lo : lo + size], size) for i, lo in own])
            self._add(size, key, np.array([i for i, _ in own]), np.array([lo for _, lo in own]))

    def _add(self, size: int, key: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        slots = np.zeros(min(SLOTS, 1 << (64 * len(key)).bit_length()), bool)
        slots[key & np.uint64(len(slots) - 1)] = True
        self.tables.append((size, slots, key[order], owner[order], offset[order]))

    def run_keys(self, words: np.ndarray, size: int) -> np.ndarray:
        """A key of the size words from each place on."""
        n = max(0, len(words) - size + 1)
        key = np.zeros(n, np.uint64)
        for d in range(size):
            key = (key ^ (key >> np.uint64(29))) * self.mixers[d] + words[d : d + n].astype(np.uint64)
        return key * self.mixers[STEPS] ^ (key >> np.uint64(31))

    @staticmethod
    def lay(texts: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
        """The texts in one array, apart by zeros, and where each begins."""
        pad, parts, begin, at = np.zeros(STEPS + STRIDE, np.int32), [], [], 0
        for words in texts:
            parts += [words, pad]
            begin.append(at)
            at += len(words) + len(pad)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), begin

    def starts(self, flat: np.ndarray) -> np.ndarray:
        """Positions that hold the least hash of some STRIDE words in a row; words outside the items never do."""
        if len(flat) < STRIDE:
            return np.zeros(0, np.int64)
        value = self.hash[flat]
        windows = value[: len(flat) - STRIDE + 1].copy()
        for d in range(1, STRIDE):
            np.minimum(windows, value[d : len(flat) - STRIDE + 1 + d], out=windows)
        chosen = np.zeros(len(flat), bool)
        for d in range(STRIDE):
            chosen[d : len(windows) + d] |= value[d : len(windows) + d] == windows
        return np.flatnonzero(chosen & (flat > 0))

    def keys(self, flat: np.ndarray, start: np.ndarray) -> Iterator[np.ndarray]:
        """A key per start, for each table of each walk."""
        for walk in range(WALKS):
            at, told = start.copy(), []
            for step in range(STEPS):
                word = flat[np.minimum(at, len(flat) - 1)]
                told.append(word)
                at += self.moves[walk, step][word]
            for picked in self.samples[walk]:
                key = (told[0].astype(np.uint64) + np.uint64(1)) * self.mixers[STEPS]
                for step in picked:
                    key = (key ^ (key >> np.uint64(29))) * self.mixers[step] + told[step].astype(np.uint64)
                yield key ^ (key >> np.uint64(31))

    def search(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, edits, end word) of the best stretch of each contaminated text and item."""
        flat, begin = self.lay(texts)
        if not self.tables or not len(flat):
            return
        start = self.starts(flat) if not self.tables[0][0] else None
        walks = self.keys(flat, start) if start is not None else iter(())
        found = []
        for size, slots, keys, owner, offset in self.tables:
            if size:
                key = self.run_keys(flat, size)
                hit = np.flatnonzero(slots[key & np.uint64(len(slots) - 1)])
                place = hit
            else:
                key = next(walks)
                hit = np.flatnonzero(slots[key & np.uint64(len(slots) - 1)])
                place = start[hit]
            lo, hi = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
            count = hi - lo
            entry = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            # an item's begin may lie up to its edits before the text
            found.append((owner[entry].astype(np.int64) << 40) + (np.repeat(place, count) - offset[entry] + (1 << 20)))
        pairs = np.unique(np.concatenate(found))
        item, at = pairs >> 40, (pairs & ((1 << 40) - 1)) - (1 << 20)
        size = self.sizes[item]
        limit = (MAX_EDITS * size).astype(np.int64)
        first, ends = np.array(begin), np.array(begin) + np.array([len(t) for t in texts])
        text = np.searchsorted(first, np.maximum(at + limit, 0), "right") - 1
        lo, hi = np.maximum(at - limit, first[text]), np.minimum(at + size + limit, ends[text])
        enough = np.zeros(len(item), bool)
        for i in range(0, len(item), 20_000):
            part = slice(i, i + 20_000)
            span = np.arange(int((hi[part] - lo[part]).max(initial=1)))
            words = flat[np.minimum(lo[part, None] + span, len(flat) - 1)]
            shared = (self.has[item[part, None], words % SPREAD] & (words > 0) & (lo[part, None] + span < hi[part, None])).sum(axis=1)
            enough[part] = shared >= size[part] - limit[part]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for n in np.flatnonzero(enough).tolist():
            where = (int(text[n]), int(item[n]))
            known = best.get(where, (int(limit[n]) + 1, 0))
            if known[0] == 0:
                continue
            edits, end = edit_distance(self.items[where[1]][1].tolist(), flat[lo[n] : hi[n]].tolist())
            if edits < known[0]:
                best[where] = (edits, int(lo[n]) + end - begin[where[0]])
        for (text, item), (edits, end) in best.items():
            yield text, item, edits, end


def edit_distance(item: list[int], window: list[int]) -> tuple[int, int]:
    """Least word edits between item and any stretch of window, and where that stretch ends (bit-parallel, one column a word)."""
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    where: dict[int, int] = {}
    for i, word in enumerate(item):
        where[word] = where.get(word, 0) | 1 << i
    up, down, score = full, 0, n
    best, end = n, 0
    for j, word in enumerate(window):
        equal = where.get(word, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        rise, fall = down | ~(horizontal | up) & full, up & horizontal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = (fall | ~(vertical | rise)) & full, rise & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


def blocks(items: DataFrame) -> Iterator[Broadcast]:
    """All usable items in blocks of about BLOCK, one at a time."""
    usable = items.select("item_id", "text").where("text IS NOT NULL")
    n = max(1, -(-usable.count() // BLOCK))
    for block in range(n):
        rows = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()
        yield items.sparkSession.sparkContext.broadcast(sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is not None, *r)))


def _searched(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]], at: int) -> Iterator[tuple[pa.RecordBatch, Index, list[tuple[int, int, int, int]]]]:
    """Parts of the batches with what was found in their texts (column at)."""
    index = Index(items)
    number = _Vocabulary(index.known)
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            laid = []
            for t in part.column(at).to_pylist():
                ws = words_of(t)
                words = np.fromiter(map(number.__getitem__, ws), np.int32, len(ws))
                laid.append(words[words >= 0])
            yield part, index, sorted(index.search(laid))


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, item_id, item_words, edits and end_word for every document and item it holds."""
    schema = f"k {dict(docs.dtypes)[key]}, item_id {dict(items.dtypes)['item_id']}, item_words long, edits long, end_word long"
    item_type = {"bigint": pa.int64(), "int": pa.int32()}.get(dict(items.dtypes)["item_id"], pa.string())
    out = None
    for block in blocks(items):

        def run(batches: Iterator[pa.RecordBatch], block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            for part, index, found in _searched(batches, block.value, 1):
                columns = [part.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([index.items[f[1]][0] for f in found], item_type)]
                columns += [pa.array([len(index.items[f[1]][1]) for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["k", "item_id", "item_words", "edits", "end_word"])

        if out is not None:  # a block's result is written before the next block comes to the driver
            out = stage(out, "contaminated")
        one = docs.select(key, text).mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("k", key)


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns; nothing is shuffled."""
    at, first = docs.columns.index(text), True
    for block in blocks(items):

        def run(batches: Iterator[pa.RecordBatch], block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            for part, _, found in _searched(batches, block.value, at):
                kept = np.ones(part.num_rows, bool)
                kept[[f[0] for f in found]] = False
                yield part.filter(pa.array(kept))

        docs, first = (docs if first else stage(docs, "clean")).mapInArrow(run, docs.schema), False
    return docs
