"""Secret scan: three base patterns, and credential values judged by their guess cost.

The base kinds (assign, access, hex) are patterns. The method adds the kind "guess": in a credential context, a value's cost is
the least sum over all its segmentations, in log10 of guesses, found by dynamic programming over the value's end positions. A
segment is a known word (by its rank, leet spellings included), a date, a repeat of up to UNIT letters, a keyboard walk, or
brute force; each further segment doubles the orders to try. Walks and repeats end anywhere in their first LONG steps or where
they can go no further, so the work grows with the value's length. Values at or over GUESS_COST are secrets.

Words are ranked by a list of common passwords and, after it, by how often the corpus itself has them: the VOCABULARY most
frequent words of letters alone, counted over all documents. That list is all that comes to the driver.

Defined results: null and empty texts have no spans; a value is judged whole, however long; a guess span that lies wholly inside
a base span is not told again, one that only overlaps it is; repeated documents are scanned row by row and count as often as
they occur; other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words as words_of

#: Fixed patterns of the base kinds, in their order; the second value is the group with the least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of [0-9a-f] are maximal either way, so the least length can stand in the pattern.
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")

CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credentials?|bearer)"""
    r"""["']?[\x20\t]*+(?:=>|[:=]|\bis\b)[\x20\t]*+["']?([^\s"',;]{6,})""",
    re.A | re.I,
)
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer")
GUESS_COST = 10.0
#: Words taken from the corpus, and how often a word must occur; steps of walks and repeats that may end at any place; longest unit.
VOCABULARY, OFTEN, LONG, UNIT = 10_000, 5, 16, 8
#: Words of letters alone; words counted in a task before their counts are passed on.
LETTERS = re.compile(r"([A-Za-z]{3,16})[.,;:!?]*")
HELD = 100_000

#: Common passwords by rank.
PASSWORDS = (
    "password the qwerty admin welcome login letmein monkey dragon master sunshine princess football baseball shadow superman"
    " hello freedom whatever trustno secret summer winter spring autumn love money test user root guest default changeme access"
    " pass key token open server system database home work family house computer internet google apple orange banana flower"
    " hunter ranger killer soccer hockey michael jordan daniel thomas robert charlie andrew jessica ashley michelle nicole"
    " that with this have from they will would there their about which when make like time just know take people into year good"
    " some could them other than then look only come over think also back after first well even want because these give most"
    " correct horse battery staple null none true false example sample placeholder dummy value string your here"
).split()
LEET = str.maketrans("0134578@$!", "oleastbasi")
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
NEXT = {a + b for row in ROWS for r in (row, row[::-1]) for a, b in zip(r, r[1:], strict=False)}
_YEAR, _MONTH, _DAY, _MARK = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", r"[-/._]?"
#: Each with the log10 of how many there are.
DATES = tuple((re.compile(p), math.log10(n)) for p, n in ((_YEAR + _MARK + _MONTH + _MARK + _DAY, 43_800), (_DAY + _MARK + _MONTH + _MARK + _YEAR, 43_800), (_YEAR, 120)))
SEGMENT = math.log10(2)


def _char_cost(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else 1.5


def common_words(docs: DataFrame, text: str = "text") -> list[str]:
    """The corpus's most frequent words of letters alone, the most frequent first; punctuation at a word's end goes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            found: Counter[str] = Counter()
            for word, n in held.items():
                if m := LETTERS.fullmatch(word):
                    found[m[1].lower()] += n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["w", "n"])

        for batch in batches:
            for t in batch.column(0):
                held.update(words_of(t.as_py()))
                if len(held) > HELD:
                    yield told()
        yield told()

    counted = docs.select(text).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return [r.w for r in counted.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "w").limit(VOCABULARY).collect()]


class Guesser:
    """Guess costs under a ranked vocabulary."""

    def __init__(self, words: Sequence[str] = ()):
        self.rank = {w: i + 1 for i, w in enumerate(dict.fromkeys([*PASSWORDS, *words]))}
        self.longest = max(map(len, self.rank))

    def segments(self, value: str) -> Callable[[int], Iterator[tuple[int, float]]]:
        """For a begin: (end, cost) of the segments there that are not brute force."""
        low, n = value.lower(), len(value)
        if len(low) != n:  # rare letters that lower-case to two
            low = value
        plain = low.translate(LEET)
        # how far a walk goes on from each place, and for how many letters it equals the letters a unit on: both from the right
        walk, same = [0] * (n + 1), [[0] * (n + 1) for _ in range(UNIT + 1)]
        for i in range(n - 2, -1, -1):
            walk[i] = walk[i + 1] + 1 if low[i : i + 2] in NEXT else 0
        for unit in range(1, UNIT + 1):
            own = same[unit]
            for i in range(n - unit - 1, -1, -1):
                if low[i] == low[i + unit]:
                    own[i] = own[i + 1] + 1

        def found(i: int) -> Iterator[tuple[int, float]]:
            for j in range(i + 3, min(n, i + self.longest) + 1):
                rank, leet = self.rank.get(low[i:j]), 0.0
                if rank is None:
                    rank, leet = self.rank.get(plain[i:j]), 0.5
                if rank is not None:
                    word = value[i:j]
                    yield j, math.log10(rank + 1) + leet + (0.0 if word.islower() else 0.3 if word.istitle() or word.isupper() else 1.0)
            if low[i].isdigit():
                for pattern, cost in DATES:
                    if m := pattern.match(low, i):
                        yield m.end(), cost
            if (size := walk[i] + 1) >= 3:
                for k in {*range(3, min(size, LONG) + 1), size}:
                    yield i + k, math.log10(47) + 0.3 * math.log2(k)
            for unit in range(1, UNIT + 1):
                copies = same[unit][i] // unit + 1
                if copies > 1:
                    once = sum(map(_char_cost, value[i : i + unit]))
                    for k in {*range(2, min(copies, LONG) + 1), copies}:
                        if k * unit >= 3:
                            yield i + k * unit, once + math.log10(k)

        return found

    def cost(self, value: str) -> float:
        """Least log10 guesses over all segmentations of value."""
        found, n = self.segments(value), len(value)
        best = [0.0] + [math.inf] * n  # the last segment ends here
        brute = [math.inf] * (n + 1)  # ... and is brute force, which goes on without a new segment
        for i in range(n):
            here = best[i] + (SEGMENT if i else 0.0)
            brute[i + 1] = min(here, brute[i]) + _char_cost(value[i])
            if brute[i + 1] < best[i + 1]:
                best[i + 1] = brute[i + 1]
            for j, cost in found(i):
                if here + cost < best[j]:
                    best[j] = here + cost
        return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), unsorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def spans(text: str, guesser: Guesser) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, index of the kind, end), in their order."""
    low = text.lower()
    if not any(hint in low for hint in HINTS):
        found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
        return sorted(found)
    found = sorted(base_spans(text))
    starts, reach = [a for a, _, _ in found], [-1, *accumulate((b for _, _, b in found), max)]
    more = [
        (m.start(1), 3, m.end(1))
        for m in CONTEXT.finditer(text)
        if reach[bisect_right(starts, m.start(1))] < m.end(1) and guesser.cost(m.group(1)) >= GUESS_COST
    ]
    return sorted(found + more)


def told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", words: list[str] | None = None) -> DataFrame:
    """key, counts per base kind, digest of the base spans, and all spans as text. words: ranked; None: those of docs."""
    kind = dict(docs.dtypes)[key]
    ranked = common_words(docs, text) if words is None else words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(ranked)
        for batch in batches:
            all_found = [spans(t, guesser) if t else [] for t in batch.column(1).to_pylist()]
            base = [[s for s in f if s[1] < 3] for f in all_found]
            counts = [pa.array([sum(s[1] == k for s in f) for f in base], pa.int64()) for k in range(3)]
            digest = [hashlib.sha256(told(f).encode()).hexdigest() for f in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digest, pa.string()), pa.array([told(f) for f in all_found], pa.string())], ["k", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = f"k {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(key, text).mapInArrow(run, schema).withColumnRenamed("k", key)


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", words: list[str] | None = None) -> DataFrame:
    """docs with every span of text replaced by mark; all other columns as they are."""
    at = docs.columns.index(text)
    ranked = common_words(docs, text) if words is None else words

    def clean(t: str | None, guesser: Guesser) -> str | None:
        found = spans(t, guesser) if t else []
        if not found:
            return t
        out, end = [], 0
        for a, _, b in found:
            if a >= end:
                out += [t[end:a], mark]
            end = max(end, b)
        return "".join([*out, t[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(ranked)
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(t, guesser) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
