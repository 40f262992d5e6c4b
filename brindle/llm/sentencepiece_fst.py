"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled from a model's pieces (a parameter; nothing is trained or copied), in the tropical semiring (min, +):

* the normaliser, a transducer of one state: a space is read as U+2581, every other letter as itself, and an arc without input
  writes one U+2581 in front. It is composed with the pieces once, when the arcs are compiled: a trie reads letters and writes
  piece ids;
* the pieces: an arc weighs -score in a unigram model. In a merge-order (BPE) model the weight lies between neighbours: an arc of
  piece b after an arc of piece a weighs 0 if the merge order keeps the border between them, and infinity otherwise, so that the
  least path is the merge order's own segmentation;
* byte fallback: a letter that is no piece has one arc, which writes its UTF-8 bytes and weighs a fallback.

A text is cut where no piece can span (the machine is back in its start state there). Each part is composed with the machine: the
arcs that fit it make a lattice, and relaxation from left to right, dist(arc) = min over the arcs that end where it begins of
(dist + border weight) + own weight, gives the shortest path, which is read back from the best last arc. New parts of a batch are
composed and relaxed together as arrays, in bounded chunks; paths of parts seen before are kept in a bounded cache.

Decoding is the machine turned round: ids read, bytes written, and the U+2581 in front taken off.

Defined results: null texts encode like empty ones, to no ids; U+2581 in a text decodes to a space, so such a text does not come
back as it was; texts of any length are encoded whole; repeated rows are encoded row by row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Paths and borders kept by a task; letters composed at a time; arcs relaxed at a time.
CACHE, BORDERS, LETTERS, ARCS = 150_000, 1 << 19, 60_000, 60_000
#: How much worse than the least piece a letter in bytes is.
PENALTY = 10.0


def load_pieces(path: str = MODEL) -> tuple[list[str], list[float], list[int]]:
    """Pieces, scores and kinds (0 normal, 1 byte, 2 other) of a model file, read by the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kind = [1 if model.is_byte(i) else 2 if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else 0 for i in ids]
    return [model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], kind


class Table:
    """A hash table of non-negative whole numbers, looked up as arrays; -1 where a key is not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self.slot(keys)
        while len(left):
            at = slot[left]
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            own = self.keys[at] == keys[left]
            self.values[at[own]] = values[left[own]]
            left = left[~own]
            slot[left] = (slot[left] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slot[left] = at = (slot[left] + 1) & self.mask
            held = self.keys[at]
            own = held == keys[left]
            out[left[own]] = self.values[at[own]]
            left = left[~own & (held >= 0)]
        return out


class Transducer:
    """The compiled machine. merge_order: a BPE model; None: told by the scores, which are whole numbers there."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], merge_order: bool | None = None):
        self.pieces, self.size = pieces, len(pieces)
        ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == 0}
        self.merge_order = all(scores[i] == int(scores[i]) for i in ids.values()) if merge_order is None else merge_order
        byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == 1}
        self.byte = np.array([byte.get(b, 0) for b in range(256)], np.int32)
        if self.merge_order:
            ids = self._merges(ids, scores)
            self.weight = np.zeros(self.size + 1)
        else:
            self.weight = np.append(-np.array(scores, float), 0.0)
        self.weight[-1] = max(self.weight[list(ids.values())], default=0.0) + PENALTY  # the fallback
        self._trie(ids)
        raw = [bytes([int(p[3:5], 16)]) if k == 1 else b"" if k == 2 else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        inner = {a + b for p in ids for a, b in zip(p, p[1:], strict=False)}
        newline = "" if any("\n" in p for p in inner) else r"\n+|"
        # cuts lie in front of spaces and around line feeds, where the pieces allow it
        if any(p[1] == SPACE != p[0] for p in inner):
            self.cut = re.compile(r"(?s).+")
        else:
            self.cut = re.compile(rf"{newline}[ {SPACE}]+[^ {SPACE}\n]*|[^ {SPACE}\n]+" if newline else rf"[ {SPACE}]+[^ {SPACE}]*|[^ {SPACE}]+")
        self.border_keys, self.border_values = np.full(BORDERS, -1, np.int64), np.zeros(BORDERS)
        self.paths: dict[str, bytes] = {}

    def _merges(self, ids: dict[str, int], scores: list[float]) -> dict[str, int]:
        """The pieces that the merge order makes. made: when a piece is made (-1: a letter); left and right: of what."""
        self.made = np.full(self.size, -1, np.int64)
        self.left, self.right = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        place = {score: n for n, score in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        rank = {i: place[scores[i]] for i in ids.values()}
        real = {}
        for piece, i in ids.items():
            parts, last = list(piece), None
            while len(parts) > 1:
                known = [(rank[ids[a + b]], n) for n, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ids]
                if not known:
                    break
                n = min(known)[1]
                last = parts[n], parts[n + 1]
                parts[n : n + 2] = ["".join(last)]
            if len(parts) > 1:
                continue
            real[piece] = i
            if last:
                self.made[i], self.left[i], self.right[i] = rank[i], ids[last[0]], ids[last[1]]
        pairs = [(real[p[:k]] << 32 | real[p[k:]], i) for p, i in real.items() for k in range(1, len(p)) if p[:k] in real and p[k:] in real]
        self.joined = Table(np.array([k for k, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int32))
        return real

    def _trie(self, ids: dict[str, int]) -> None:
        """Arcs of the normaliser composed with the pieces: both a space and U+2581 in the text are read where a piece has U+2581."""
        steps: dict[tuple[int, str], int] = {}
        ends = {0: -1}
        for piece, i in ids.items():
            node = 0
            for c in piece:
                node = steps.setdefault((node, c), len(steps) + 1)
            ends[node] = i
        self.writes = np.full(len(steps) + 1, -1, np.int64)
        self.writes[list(ends)] = list(ends.values())
        keys = {node << 21 | ord(letter): to for (node, c), to in steps.items() for letter in (c, " ")[: 2 if c == SPACE else 1]}
        self.steps = Table(np.array(list(keys), np.int64), np.array(list(keys.values()), np.int32))

    def borders(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Weights between neighbouring pieces a and b. Those worked out lately are kept, one in each place of a table."""
        out = np.zeros(len(a))
        if not self.merge_order:
            return out
        both = np.flatnonzero((a < self.size) & (b < self.size))  # nothing merges with a letter in bytes
        keys = a[both] << 32 | b[both]
        place = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % BORDERS
        out[both] = self.border_values[place]
        new = np.flatnonzero(self.border_keys[place] != keys)
        if len(new):
            fresh, index = np.unique(keys[new], return_inverse=True)
            told = self._kept(fresh >> 32, fresh & 0xFFFFFFFF)[index]
            out[both[new]] = told
            self.border_keys[place[new]], self.border_values[place[new]] = keys[new], told
        return out

    def _kept(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """0 where the merge order keeps the border between a and b, infinity elsewhere.

        Merges are taken back from the last one on: the piece made later of the two at the border falls into its parts. At any
        time a merge across the border that comes before the merge taken back would have been made instead; among equal merges
        the left one comes first.
        """
        out = np.zeros(len(a))
        which, bound = np.arange(len(a)), np.full(len(a), np.iinfo(np.int64).max)
        while len(which):
            across = self.joined(a << 32 | b)
            broken = (across >= 0) & (self.made[across] < bound)
            out[which[broken]] = np.inf
            on = ~broken & ((self.made[a] >= 0) | (self.made[b] >= 0))
            which, a, b = which[on], a[on], b[on]
            later = self.made[a] > self.made[b]
            bound = np.where(later, self.made[a], self.made[b] + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out

    def lattice(self, codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and piece of all arcs that fit the letters; stop: where each letter's part ends. Piece size: a letter in bytes."""
        at, node, depth = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        found, alone = [], np.ones(len(codes), bool)
        while len(at):
            node = self.steps(node << 21 | codes[at + depth]).astype(np.int64)
            on = node >= 0
            at, node, depth = at[on], node[on], depth + 1
            piece = self.writes[node]
            ends = piece >= 0
            found.append((at[ends], depth, piece[ends]))
            if depth == 1:
                alone[at[ends]] = False
            on = at + depth < stop[at]
            at, node = at[on], node[on]
        bare = np.flatnonzero(alone)
        found.append((bare, 1, np.full(len(bare), self.size)))
        begin = np.concatenate([f[0] for f in found])
        return begin, begin + np.repeat([f[1] for f in found], [len(f[0]) for f in found]), np.concatenate([f[2] for f in found])

    def shortest_paths(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each part: where its ids end in the array of ids, all ids, and the weight of its path."""
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(parts)), sizes)
        begin, end, piece = self.lattice(codes, (first + sizes)[owner])
        part = owner[begin]
        order = np.lexsort((begin, begin - first[part]))  # by the place within the part
        begin, end, piece, part = begin[order], end[order], piece[order], part[order]
        level = begin - first[part]
        n, weight = len(begin), self.weight[piece]
        into = np.argsort(end + part, kind="stable")  # a part has one state more than letters
        states = (end + part)[into]
        low, high = np.searchsorted(states, begin + part, "left"), np.searchsorted(states, begin + part, "right")
        dist, back = np.append(np.full(n, np.inf), np.inf), np.full(n, n)
        heads = np.searchsorted(level, 0, "right")
        dist[:heads] = weight[:heads]
        bounds = np.flatnonzero(np.concatenate(([True], level[1:] != level[:-1], [True])))
        k = 1
        while k < len(bounds) - 1:
            last = max(k + 1, int(np.searchsorted(bounds, bounds[k] + ARCS, "right")) - 1)
            a, b = bounds[k], bounds[last]
            count = np.maximum(high[a:b] - low[a:b], 1)
            offset = np.concatenate(([0], np.cumsum(count)))
            to = np.repeat(np.arange(a, b), count)
            before = np.repeat(low[a:b], count) + np.arange(len(to)) - np.repeat(offset[:-1], count)
            reached = (high > low)[to]
            source = np.where(reached, into[np.minimum(before, n - 1)], n)
            border = np.full(len(to), np.inf)
            border[reached] = self.borders(piece[source[reached]], piece[to[reached]])
            for x, y in zip(bounds[k:last], bounds[k + 1 : last + 1], strict=True):
                p, q = offset[x - a], offset[y - a]
                way = dist[source[p:q]] + border[p:q]
                least = np.minimum.reduceat(way, offset[x - a : y - a] - p)
                hit = np.flatnonzero(way == np.repeat(least, count[x - a : y - a]))[::-1]
                back[to[p:q][hit]] = source[p:q][hit]  # the first of equals is written last
                dist[x:y] = least + weight[x:y]
            k = last
        # the best arc into each part's last state, and back along the path
        goal = first + sizes + np.arange(len(parts))
        low = np.searchsorted(states, goal, "left")
        span = np.searchsorted(states, goal, "right") - low
        lasts = dist[into]
        here = np.empty(len(parts), np.int64)
        every = np.repeat(low, span) + np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span)
        best = np.minimum.reduceat(lasts[every], np.cumsum(span) - span)
        hit = np.flatnonzero(lasts[every] == np.repeat(best, span))[::-1]
        here[np.repeat(np.arange(len(parts)), span)[hit]] = into[every[hit]]
        path = []
        while len(here):
            path.append(here)
            here = here[level[here] > 0]
            here = back[here]
        taken = np.concatenate(path)
        taken = taken[np.argsort(begin[taken])]
        told, count = piece[taken].astype(np.int32), np.ones(len(taken), np.int64)
        bare = np.flatnonzero(told == self.size)
        if len(bare):
            spelt = [(chr(c) if c != 32 else SPACE).encode("utf-8", "replace") for c in codes[begin[taken[bare]]].tolist()]
            count[bare] = [len(s) for s in spelt]
            told = np.repeat(told, count)
            told[told == self.size] = self.byte[np.frombuffer(b"".join(spelt), np.uint8)]
        ends = np.cumsum(np.bincount(part[taken], count, len(parts)).astype(np.int64))
        return ends, told, best

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        """Packed ids of new parts, composed in chunks of about LETTERS letters."""
        out: dict[str, bytes] = {}
        i = 0
        while i < len(parts):
            chunk, size = [], 0
            while i < len(parts) and (not chunk or size + len(parts[i]) <= LETTERS):
                chunk.append(parts[i])
                size += len(parts[i])
                i += 1
            ends, ids, _ = self.shortest_paths(chunk)
            data, ends = ids.astype("<i4").tobytes(), (4 * ends).tolist()
            out |= {p: data[a:b] for p, a, b in zip(chunk, [0, *ends], ends, strict=False)}
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed little-endian 32-bit ids of each text."""
        cut = [self.cut.findall(SPACE + t) if t else [] for t in texts]
        parts = set(chain.from_iterable(cut))
        if len(self.paths) > CACHE:  # keep those in use
            self.paths = {p: ids for p, ids in self.paths.items() if p in parts}
        new = parts.difference(self.paths)
        known: dict[str, bytes] = self.paths
        if new:
            learnt = self.learn(sorted(new, key=len))
            self.paths |= {p: ids for p, ids in learnt.items() if len(p) <= 64}
            if len(learnt) and max(map(len, learnt)) > 64:
                known = {**self.paths, **learnt}
        return [b"".join(map(known.__getitem__, own)) for own in cut]

    def decode(self, ids: np.ndarray) -> str:
        size = self.raw_size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.raw_at[ids] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
        data = self.raw[at].tobytes()
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def encode(docs: DataFrame, model: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 (of packed little-endian 32-bit ids), round_trip (decoding gives the text back) and ids."""
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(model))  # bounded: a vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(*shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = part.column(1).to_pylist()
                packed = machine.encode(texts)
                arrays = [np.frombuffer(p, "<i4") for p in packed]
                same = [machine.decode(a) == (t or "") for a, t in zip(arrays, texts, strict=True)]
                sizes = [len(a) for a in arrays]
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()), pa.array(same, pa.bool_())]
                offsets = pa.array(list(chain([0], np.cumsum(sizes).tolist())), pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*arrays, np.zeros(0, "<i4")]), pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["k", "n_tokens", "ids_sha256", "round_trip", "ids"])

    schema = f"k {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, round_trip boolean, ids array<int>"
    return docs.select(key, text).mapInArrow(run, schema).withColumnRenamed("k", key)


def decode(tokens: DataFrame, model: str = MODEL, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and the text that ids spell."""
    shared = tokens.sparkSession.sparkContext.broadcast(load_pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(*shared.value)
        for batch in batches:
            texts = [machine.decode(np.array(x or [], np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["k", "text"])

    return tokens.select(key, ids).mapInArrow(run, f"k {dict(tokens.dtypes)[key]}, text string").withColumnRenamed("k", key)
