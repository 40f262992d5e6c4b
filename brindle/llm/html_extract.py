"""Main text of web pages: a suffix array over the pages of each host, and page structure.

A page is read into one stream of all its visible tokens, menus and footers included, with a mark between blocks. Tokens are
known as part of a marked article (article or main), of an element that never holds article text (by tag, role, class or id), or
as neither.

1. The pages of a host are dealt by a hash into shards of about SHARD_PAGES. A shard's streams are concatenated, and a suffix array
   with its longest common prefixes brings equal substrings together: every interval of RUN and more common tokens is one run,
   with the distinct pages it stands on. A run that reaches a share of the host's pages reaches it in one shard at least, so the
   runs that do are all that can; these are counted in every shard, and the sums decide. The result does not depend on the shards.
2. A run is boilerplate if it stands on one in ONE_IN of the host's distinct pages, and on LEAST at least. Tokens that
   boilerplate covers go; what is unique stays. Inside a marked article a run goes only from nine in ten pages and COMMON pages on,
   since copies of an article and passages that articles share are article text.
3. What the array leaves and structure tells to be no article text goes too: unique adverts, comments, forms, and, on a page with a
   marked article, everything outside it.

Near copies of a page count as one page, so that copies of an article without mark do not erase each other. Pages whose longest blocks
agree in the least run hash of one of several orders are near copies; each counts with the first of those it agrees with.

n_repeated counts the words that the array took, n_marked those that only structure did.

Defined results: null and empty html give an empty text; pages with a null url share the empty host; end tags that HTML lets authors
omit are implied; a left-out element that is never closed ends with its parent, or where an article begins. A token and a run
are known by 64-bit hashes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage

SHARD_PAGES, RUN, COMMON, ONE_IN, LEAST = 256, 8, 8, 100, 3
CACHE = 200_000
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|svg|iframe|select)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s>/]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Fixed lists: elements never part of an article; inline elements, which do not end a block; elements without an end.
LEFT_OUT = frozenset("nav header footer aside form button head dialog menu".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset(("article", "main"))
#: Elements that end where one of these begins, and the elements that keep them open further out.
ENDED_BY = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
}
#: Names in class, id or role of an element that is no article text, whole or as the first part; places that may stand before.
MARKS = frozenset(
    (
        "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs"
        " header masthead footer sidebar aside widget cookie cookies consent notice notices alert gdpr popup modal newsletter subscribe signup login"
        " comment comments disqus replies share sharing social related recommended search form complementary contentinfo"
    ).split()
)
PLACES = frozenset("site page main global top bottom left right primary secondary".split())
PARTS = re.compile(r"[^a-z0-9]+")
BLOCK = "\n"
#: Odd numbers, each an order of the run hashes.
MIXERS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F], np.uint64)


@lru_cache(4096)
def _left_out(tag: str, attributes: str) -> bool:
    if tag in LEFT_OUT:
        return True
    if tag in ARTICLE or tag in ("body", "html") or "=" not in attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = PARTS.split(name)
            if parts[0] in MARKS or (len(parts) == 2 and parts[0] in PLACES and parts[1] in MARKS):
                return True
    return False


def blocks(page: str | None) -> list[tuple[str, list[str]]]:
    """The blocks of a page in order: their kind (a: of a marked article, x: no article text, o: other) and tokens."""
    found: list[tuple[str, list[str]]] = []
    pieces: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether they are left out
    articles = hidden = paragraphs = at = 0
    page = page or ""

    def end() -> None:
        if pieces:
            tokens = html.unescape("".join(pieces)).split()
            if tokens:
                found.append(("x" if hidden else "a" if articles else "o", tokens))
            pieces.clear()

    def pop(k: int) -> None:
        nonlocal articles, hidden, paragraphs
        for tag, out in stack[k:]:
            hidden -= out
            paragraphs -= tag == "p"
            articles -= tag in ARTICLE and not out
        del stack[k:]

    def innermost(tags: frozenset[str] | tuple[str, ...], outer: frozenset[str] = frozenset()) -> int:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in outer:
                break
        return -1

    for m in TOKEN.finditer(page):
        if m.start() > at:
            pieces.append(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1]:
                end()
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if m[2]:
            k = innermost((tag,))
            if tag not in INLINE or (k >= 0 and stack[k][1]):
                if pieces:
                    end()
                if k >= 0:
                    pop(k)
            continue
        if tag in INLINE:
            if _left_out(tag, m[4]):
                end()
                stack.append((tag, True))
                hidden += 1
            continue
        if pieces:
            end()
        if stack and stack[-1][0] == "head" and tag not in EMPTY:
            pop(len(stack) - 1)
        if paragraphs:
            pop(innermost(("p",)))  # no block lies in a paragraph
        if tag in ENDED_BY and (k := innermost(*ENDED_BY[tag])) >= 0:
            pop(k)
        if tag in EMPTY:
            continue
        if tag in ARTICLE and hidden:
            # the element left out wraps the page, or was never closed
            k = next(i for i, (_, out) in enumerate(stack) if out)
            outer = stack[k][0]
            if outer == "form" or (outer not in LEFT_OUT and tag == "main") or f"</{outer}" not in page[at:].lower():
                hidden = 0
                stack[:] = [(t, False) for t, _ in stack]
        out = _left_out(tag, m[4])
        stack.append((tag, out))
        hidden += out
        paragraphs += tag == "p"
        articles += tag in ARTICLE and not out
    rest = page[at:]
    cut = re.search(r"<[a-zA-Z/!?][^<>]*\Z", rest)  # a tag that the page's end breaks off
    pieces.append(rest[: cut.start()] if cut else rest)
    end()
    return found


class SuffixArray:
    """Suffix array of a token array by prefix doubling, and the longest common prefixes of its neighbours.

    depth: sort by so many tokens at least (None: all).
    """

    def __init__(self, tokens: np.ndarray, depth: int | None = None):
        n = len(tokens)
        self.order = np.argsort(tokens)
        own, place = tokens[self.order], np.arange(n)
        fresh = np.concatenate(([True], own[1:] != own[:-1]))[:n]
        rank = np.empty(n, np.int64)
        rank[self.order] = np.maximum.accumulate(np.where(fresh, place, 0))  # a class is named by its first place
        levels, width = [rank], 1
        open_ = self._shared(rank, self.order)
        while len(open_) and width < min(n, depth or n):
            after = np.full(len(open_), -1, np.int64)
            inside = open_ + width < n
            after[inside] = rank[open_[inside] + width]
            by = np.argsort(rank[open_] * (n + 1) + after)  # open_ is a part of order: two ranks fit one number
            open_, after = open_[by], after[by]
            own = rank[open_]
            fresh = np.concatenate(([True], (own[1:] != own[:-1]) | (after[1:] != after[:-1])))
            begins = np.concatenate(([True], own[1:] != own[:-1]))
            place = np.arange(len(open_))
            first = np.maximum.accumulate(np.where(begins, place, 0))
            rank = rank.copy()
            rank[open_] = own + np.maximum.accumulate(np.where(fresh, place, 0)) - first
            self.order[own + place - first] = open_
            levels.append(rank)
            width *= 2
            open_ = self._shared(rank, open_)
        self.common = self._common(levels, n)

    @staticmethod
    def _shared(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Those of the suffixes (sorted by rank) whose rank another one has."""
        own = rank[at]
        if not len(own):
            return at
        same = np.concatenate(([False], own[1:] == own[:-1], [False]))
        return at[same[1:] | same[:-1]]

    def _common(self, levels: list[np.ndarray], n: int) -> np.ndarray:
        """Of each suffix in order: how many tokens it shares with the one before."""
        common = np.zeros(n, np.int64)
        if n < 2:
            return common
        i, j = self.order[:-1].copy(), self.order[1:].copy()
        for k in range(len(levels) - 1, -1, -1):
            near = np.flatnonzero((i < n) & (j < n))
            near = near[levels[k][i[near]] == levels[k][j[near]]]
            # equal ranks of suffixes cut off by the end cannot be: separators differ
            common[near + 1] += 1 << k
            i[near] += 1 << k
            j[near] += 1 << k
        return common

    def classes(self, length: int) -> np.ndarray:
        """By position: the number of its interval of suffixes with length and more tokens in common."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.common < length)
        return out


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[token] = value = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        return value


#: One a worker.
_hashes = _Hashes()


def run_hashes(tokens: np.ndarray) -> np.ndarray:
    """Hash of the RUN tokens from each place on, given the tokens' hashes."""
    n = max(0, len(tokens) - RUN + 1)
    out = np.zeros(n, np.uint64)
    for d in range(RUN):
        out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[d : d + n]
    return out ^ (out >> np.uint64(31))


def stream(found: list[tuple[str, list[str]]]) -> str:
    """Blocks as lines of their kind and tokens."""
    return "\n".join(f"{kind} {' '.join(tokens)}" for kind, tokens in found)


def split(text: str) -> list[str]:
    """A stream's tokens, with a mark after each block."""
    return [*f" {BLOCK} ".join([line[2:] for line in text.split("\n")]).split(" "), BLOCK] if text else []


def kinds_of(text: str) -> str:
    """The kind of each of a stream's tokens (b: the mark)."""
    return "".join([line[0] * line.count(" ") + "b" for line in text.split("\n")]) if text else ""


def tokens_of(text: str) -> tuple[list[str], str]:
    """A stream's tokens, with a mark after each block, and the kind of each (b: the mark)."""
    return split(text), kinds_of(text)


def signs(text: str) -> list[int]:
    """Least run hashes of a stream's longest block over the orders of MIXERS, of which near copies share most."""
    longest = max(text.split("\n"), key=lambda line: line.count(" "))[2:].split(" ")
    runs = run_hashes(np.fromiter(map(_hashes.__getitem__, longest), np.uint64, len(longest)))
    if not len(runs):
        runs = np.array([xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))], np.uint64)
    return [int((runs * mixer).min()) - 2**63 for mixer in MIXERS]


def least(n: int) -> int:
    """On how many of a host's n distinct pages a run is boilerplate."""
    return max(LEAST, -(-n // ONE_IN))


class Shard:
    """The token streams of a shard in one array, each ended by a token of its own."""

    def __init__(self, group: pd.DataFrame):
        self.texts = list(group["text"])
        self.streams = [split(t) for t in self.texts]
        sizes = np.array([len(s) + 1 for s in self.streams], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(sizes)))
        self.page = np.repeat(np.arange(len(sizes)), sizes)
        ends = self.begin[1:] - 1
        inner = np.ones(int(sizes.sum()), bool)
        inner[ends] = False
        hashes = np.zeros(len(inner), np.uint64)
        hashes[inner] = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(self.streams)), np.uint64, len(inner) - len(ends))
        # tokens are known by 63 bits of their hash; separators are their own
        self.tokens = (hashes >> np.uint64(1)).astype(np.int64)
        self.tokens[ends] = -1 - np.arange(len(ends))
        left = np.repeat(self.begin[1:], sizes) - np.arange(len(self.tokens))
        self.at = np.flatnonzero(left > RUN)  # RUN tokens before the separator
        self.run = run_hashes(hashes)[self.at].view(np.int64) if len(self.at) else np.zeros(0, np.int64)

    def kinds(self) -> np.ndarray:
        """By token: its kind (b: a mark, e: an end)."""
        return np.frombuffer("".join([kinds_of(t) + "e" for t in self.texts]).encode(), np.uint8)

    def chosen(self, group: pd.DataFrame, facts: pd.DataFrame) -> np.ndarray:
        """By page: whether it counts, as the one of its near copies that was chosen."""
        keys = facts.loc[facts["kind"] == 0, "value"].to_numpy(np.int64)
        own = group["key"].to_numpy(np.int64)
        counts = np.isin(own, keys)
        counts[np.setdiff1d(np.arange(len(own)), np.unique(own, return_index=True)[1])] = False  # a repeated row
        return counts

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """By token: whether one of the runs that starts tells lies over it."""
        edge = np.zeros(len(self.tokens) + RUN, np.int64)
        np.add.at(edge, self.at[starts], 1)
        np.add.at(edge, self.at[starts] + RUN, -1)
        return np.cumsum(edge)[: len(self.tokens)] > 0


def _frame(schema: str, *columns: list | np.ndarray) -> pd.DataFrame:
    """Of Python objects, which Arrow takes whatever pandas would make of them."""
    return pd.DataFrame({name: pd.Series(list(values), dtype=object) for name, values in zip(schema.split(), columns, strict=True)})


def candidates(key: tuple, group: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
    """host and run: runs that have the least share in this shard."""
    none = _frame("host run", [], [])
    if not len(facts) or not len(group) or int(facts["n"].iloc[0]) < LEAST:
        return none
    shard, n = Shard(group), int(facts["n"].iloc[0])
    counts = shard.chosen(group, facts)
    if not len(shard.at) or not counts.any():
        return none
    classes, width = SuffixArray(shard.tokens, RUN).classes(RUN)[shard.at], len(shard.streams)
    # no run stands on more pages than it has places
    often = np.flatnonzero(np.bincount(classes)[classes] * n >= least(n) * counts.sum())
    pairs = np.unique(classes[often] * width + shard.page[shard.at[often]])
    count = np.bincount(pairs // width, weights=counts[pairs % width], minlength=int(classes.max()) + 1)[classes[often]]
    found = np.unique(shard.run[often[(count > 0) & (count * n >= least(n) * counts.sum())]])
    return _frame("host run", [key[0]] * len(found), found.tolist())


def tally(key: tuple, group: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
    """host, run and on how many counted pages of this shard the candidate stands."""
    runs = np.sort(facts.loc[facts["kind"] == 1, "value"].to_numpy(np.int64))
    if not len(runs) or not len(group):
        return _frame("host run pages", [], [], [])
    group = group[group["key"].isin(facts.loc[facts["kind"] == 0, "value"])].drop_duplicates("key")  # the pages that count
    shard = Shard(group)
    place = np.minimum(np.searchsorted(runs, shard.run), len(runs) - 1)
    hit = runs[place] == shard.run
    width = len(shard.streams)
    pages = np.bincount(np.unique(place[hit] * width + shard.page[shard.at][hit]) // width, minlength=len(runs))
    return _frame("host run pages", [key[0]] * int((pages > 0).sum()), runs[pages > 0].tolist(), pages[pages > 0].tolist())


def settle(key: tuple, group: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
    """page_id, url, text, n_chars, n_repeated and n_marked of a shard's pages."""
    facts = facts.sort_values("value")
    runs, pages = facts["value"].to_numpy(np.int64), facts["pages"].to_numpy(np.int64)
    shard = Shard(group)
    repeated = np.zeros(len(shard.tokens), bool)
    kinds = shard.kinds()
    article = kinds == ord("a")
    if len(runs) and len(shard.at):
        n = int(facts["n"].iloc[0])
        place = np.minimum(np.searchsorted(runs, shard.run), len(runs) - 1)
        count = np.where(runs[place] == shard.run, pages[place], 0)
        repeated = shard.covered(count >= least(n)) & ~article
        repeated |= shard.covered((count >= max(COMMON, LEAST)) & (10 * count >= 9 * n)) & article
    words = (kinds != ord("b")) & (kinds != ord("e"))
    with_article = np.array([t.startswith("a ") or "\na " in t for t in shard.texts], bool)
    marked = (kinds == ord("x")) | ((kinds == ord("o")) & with_article[shard.page])
    kept = words & ~repeated & ~marked
    texts, taken, told = [], [], []
    for s, a, b in zip(shard.streams, shard.begin, shard.begin[1:], strict=False):
        texts.append(" ".join([t for t, k in zip(s, kept[a : b - 1].tolist(), strict=True) if k]))
        taken.append(int((repeated[a:b] & words[a:b]).sum()))
        told.append(int((marked[a:b] & ~repeated[a:b] & words[a:b]).sum()))
    urls = [u if isinstance(u, str) else None for u in group["url"]]
    ids = [i if isinstance(i, str) else None for i in group["page_id"]]
    return _frame("page_id url text n_chars n_repeated n_marked", ids, urls, texts, [len(t) for t in texts], taken, told)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated and n_marked of every page."""
    kind = dict(pages.dtypes)["page_id"]
    host = ascii_lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    # ids travel as text: pandas makes floats of whole numbers beside nulls
    named = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", host.alias("host"), "html")

    def read(batches: Iterator[pa.RecordBatch], signed: bool = False) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [stream(blocks(h)) for h in part.column(3).to_pylist()]
                told = {"signs": pa.array([signs(t) for t in texts], pa.list_(pa.int64()))} if signed else {}
                yield pa.RecordBatch.from_pydict(dict(zip(("page_id", "url", "host"), part.columns[:3], strict=True)) | {"text": pa.array(texts, pa.string())} | told)

    shape, key = "page_id string, url string, host string, text string", F.xxhash64("page_id", "url", "text")
    streams = named.mapInArrow(read, shape).withColumn("key", key)
    with_signs = named.mapInArrow(partial(read, signed=True), f"{shape}, signs array<long>").withColumn("key", key)
    # staged, so that Spark knows their size before it plans the joins; pages are dealt by host and shard rather than by host
    signed = stage(with_signs.where("text <> ''").select("host", "key", F.posexplode("signs").alias("place", "sign")), "signs")
    leaders = stage(signed.groupBy("host", "place", "sign").agg(F.min("key").alias("fold")), "leaders")
    folded = signed.join(leaders, ["host", "place", "sign"]).groupBy("host", "key").agg(F.min("fold").alias("fold"))
    chosen = stage(folded.groupBy("host", "fold").agg(F.min("key").alias("key")), "chosen")
    counts = named.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / SHARD_PAGES).alias("shards"))
    hosts = stage(counts.join(chosen.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "host", "left"), "hosts")
    shard = F.expr("pmod(key, shards)").alias("shard")
    # one exchange, which Spark reuses for every reading
    dealt = streams.join(hosts.select("host", "shards"), "host").select("page_id", "url", "host", "text", "key", shard).repartition("host", "shard")
    facts = chosen.join(hosts, "host").select("host", shard, F.lit(0).alias("kind"), F.col("key").alias("value"), F.lit(0).cast("long").alias("pages"), "n")

    def to_shards(runs: DataFrame) -> DataFrame:
        every = runs.join(hosts, "host").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
        return every.select("host", "shard", F.lit(1).alias("kind"), F.col("run").alias("value"), "pages", "n")

    def with_shards(other: DataFrame, made: Callable, schema: str) -> DataFrame:
        return dealt.groupBy("host", "shard").cogroup(other.groupBy("host", "shard")).applyInPandas(made, schema)

    may = with_shards(facts, candidates, "host string, run long").distinct().withColumn("pages", F.lit(0).cast("long"))
    counted = with_shards(facts.unionByName(to_shards(may)), tally, "host string, run long, pages long").groupBy("host", "run").agg(F.sum("pages").alias("pages"))
    counted = counted.join(hosts.select("host", "n"), "host").where(f"pages >= greatest({LEAST}, ceil(n / {ONE_IN}))").select("host", "run", "pages")
    told = with_shards(to_shards(counted), settle, "page_id string, url string, text string, n_chars long, n_repeated long, n_marked long")
    return told.withColumn("page_id", F.col("page_id").cast(kind))
