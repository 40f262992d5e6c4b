"""Text expressions: pure Column functions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Korean particles, tried in this order.
PARTICLES = (
    "에게서", "이라도", "으로써", "으로서", "에서는", "에게는", "이라는", "라는", "에서", "에게", "한테", "으로", "처럼", "만큼", "보다", "부터", "까지",
    "조차", "마저", "밖에", "이나", "이랑", "하고", "같이", "께서", "이란", "라도", "은", "는", "이", "가", "을", "를", "의", "에", "와", "과",
    "도", "만", "로", "랑", "께",
)
#: Signs of a question that has several parts.
COMPLEX_SIGNS = (
    "이고", "이며", "하는", "이면서", "이자", "담당하는", "작성한", "소속된", "승인한", "결정한", "관련된", "연관된", "포함된", "연결된",
    "중에서", "기준으로", "에서의", "으로의", "누가", "어느", "어떤 팀", "어떤 사람", "기반으로", "따라서", "통해서",
)
CHUNK_SIZE, CHUNK_OVERLAP = 800, 200
WINDOW_SIZE, WINDOW_OVERLAP = 6000, 600


def tokens(text: Column) -> Column:
    """Lower-cased ASCII words, then Hangul runs as bigrams (a single letter stays)."""
    ascii_words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))
    hangul = F.regexp_extract_all(text, F.lit("[가-힣]+"), F.lit(0))
    pairs = F.flatten(
        F.transform(hangul, lambda w: F.when(F.length(w) == 1, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: w.substr(i, F.lit(2)))))
    )
    return F.concat(ascii_words, pairs)


def norm_key(text: Column) -> Column:
    """Lower case without white space, punctuation or underscores."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def trigram_set(text: Column) -> Column:
    """Distinct character trigrams of the text without white space; shorter texts are their own set."""
    # the text goes through an array of one, so that its white space is taken out once and not for every trigram
    grams = lambda b: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(b) - 2), lambda i: b.substr(i, F.lit(3))))
    bare = F.array(F.regexp_replace(text, r"\s+", ""))
    return F.get(F.transform(bare, lambda b: F.when(F.length(b) < 3, F.array(b)).otherwise(grams(b))), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def strip_particle(word: Column) -> Column:
    """word without the first particle in the list that ends it, if two letters are left."""
    out = word
    for particle in reversed(PARTICLES):
        out = F.when(word.endswith(particle) & (F.length(word) - len(particle) >= 2), word.substr(F.lit(1), F.length(word) - len(particle))).otherwise(out)
    return out


def entity_candidates(text: Column, limit: int = 6) -> Column:
    """Words without outer punctuation and their stems, of two letters and more, in the order they first appear."""
    words = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    both = F.flatten(F.transform(words, lambda w: F.array(w, strip_particle(w))))
    return F.slice(F.array_distinct(F.filter(both, lambda w: F.length(w) >= 2)), 1, limit)


def names_token(text: Column, name: Column) -> Column:
    """Whether text holds name; a purely ASCII name must not touch other ASCII letters or digits."""
    escaped = F.regexp_replace(name, r"([^A-Za-z0-9_])", r"\\$1")
    bounded = F.regexp_like(text, F.concat(F.lit("(?<![A-Za-z0-9])"), escaped, F.lit("(?![A-Za-z0-9])")))
    return F.when(name.rlike("^[A-Za-z0-9_-]+$"), bounded).otherwise(F.contains(text, name))


def _windows(text: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: text.substr(i * step + 1, F.lit(size)))


def chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping pieces, trimmed, without empty ones."""
    return F.filter(F.transform(_windows(text, size, overlap), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: c != "")


def extraction_windows(text: Column, size: int = WINDOW_SIZE, overlap: int = WINDOW_OVERLAP) -> Column:
    """Overlapping windows as they are; blank ones are dropped."""
    return F.filter(_windows(text, size, overlap), lambda w: w.rlike(r"\S"))


def embedding_text(title: Column, chunk: Column) -> Column:
    return F.concat_ws("\n\n", F.nullif(F.trim(title), F.lit("")), chunk)


def anchor_window(chunk_texts: Column, anchors: Column, size: int) -> Column:
    """The part of a page (its chunks joined by blank lines) of at most size letters that covers most anchor chunks.

    A window may begin a third of size before an anchor chunk; the first of the best wins; cut ends are marked.
    """
    page = F.array_join(chunk_texts, "\n\n")
    begin = F.transform(anchors, lambda a: F.aggregate(F.slice(chunk_texts, 1, a), F.lit(0), lambda s, c: s + F.length(c) + 2))
    starts = F.transform(begin, lambda b: F.greatest(b - F.lit(size // 3), F.lit(0)))
    score = F.transform(starts, lambda s, i: F.struct(F.size(F.filter(begin, lambda b: (b >= s) & (b < s + size))).alias("n"), (-i).alias("i"), s.alias("s")))
    start = F.coalesce(F.array_max(score)["s"], F.lit(0))
    cut = F.concat(F.when(start > 0, F.lit("…")).otherwise(""), page.substr(start + 1, F.lit(size)), F.when(start + size < F.length(page), F.lit("…")).otherwise(""))
    return F.when(F.length(page) <= size, page).otherwise(cut)


def assemble(chunk: Column, index: Column) -> Column:
    """Aggregate: a page's chunks in order, joined by blank lines; overlaps stay."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(index.alias("i"), chunk.alias("t")))), lambda x: x["t"]), "\n\n")


def safe_filename(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r'[\\/:*?"<>|\s]+', "_"), 1, 80)


def answer_key(text: Column) -> Column:
    """The first of the longest identifier-like words (8 letters and more that hold a digit or one of . _ -), lower-cased; else empty."""
    found = F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_.\-]{8,}"), F.lit(0)), lambda w: w.rlike(r"[0-9._\-]"))
    best = F.array_max(F.transform(found, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))
    return F.coalesce(F.lower(best["w"]), F.lit(""))


def safe_label(text: Column, default: str = "Unknown") -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(text, "[^A-Za-z0-9_]", ""), F.lit("")), F.lit(default))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")).cast("long")


def is_complex(question: Column, min_chars: int = 12, min_words: int = 5) -> Column:
    signs = F.lit(False)
    for sign in COMPLEX_SIGNS:
        signs = signs | F.contains(question, F.lit(sign))
    return ((F.length(F.trim(question)) >= min_chars) & signs) | (word_count(question) >= min_words)


def keywords(text: Column) -> Column:
    """Comma-separated keywords, trimmed, of two letters and more."""
    return F.filter(F.transform(F.split(text, ","), lambda k: F.trim(k)), lambda k: F.length(k) >= 2)


def any_keyword(words: Column, *fields: Column) -> Column:
    """Whether any of the keywords is in any of the fields."""
    hit = lambda k: F.exists(F.array(*[F.coalesce(f, F.lit("")) for f in fields]), lambda f: F.contains(F.lower(f), F.lower(k)))
    return F.exists(words, hit)


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit("0.0%")).otherwise(F.format_string("%.1f%%", 100.0 * part / whole))


def block_markdown(kind: Column, text: Column, depth: Column, checked: Column, language: Column) -> Column:
    """A document block as a line of markdown."""
    pad = F.repeat(F.lit("  "), depth)
    line = F.concat(pad, text)
    marks = {"heading_1": "# ", "heading_2": "## ", "heading_3": "### ", "bulleted_list_item": "- ", "numbered_list_item": "1. ", "quote": "> ", "callout": "> ", "toggle": "- "}
    for name, mark in marks.items():
        heading = name.startswith("heading")
        line = F.when(kind == name, F.concat(F.lit("") if heading else pad, F.lit(mark), text)).otherwise(line)
    line = F.when(kind == "to_do", F.concat(pad, F.when(checked, "- [x] ").otherwise("- [ ] "), text)).otherwise(line)
    line = F.when(kind == "code", F.concat(F.lit("```"), F.coalesce(language, F.lit("")), F.lit("\n"), text, F.lit("\n```"))).otherwise(line)
    return F.when(kind == "divider", F.lit("---")).otherwise(line)


def table_markdown(rows: Column, header: Column) -> Column:
    """Rows of cells as a markdown table; header: whether the first row is one."""
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(rows[0])))
    return F.array_join(F.when(header & (F.size(rows) > 0), F.array_insert(lines, 2, rule)).otherwise(lines), "\n")


def decoded(text: Column) -> Column:
    """text with its character references decoded, named ones by the standard's list; unknown names stay, bad numbers become U+FFFD."""
    # the list is a constant: one JSON text, which Spark reads once
    known = F.from_json(F.lit(json.dumps({name: letters for name, letters in html5.items() if name.endswith(";") and letters != "&"})), "map<string,string>")
    hexed = lambda r: F.conv(F.regexp_extract(r, "^&#[xX]0*([0-9A-Fa-f]{1,8});", 1), 16, 10)
    code = lambda r: F.coalesce(F.nullif(F.when(r.rlike("^&#[xX]"), hexed(r)).otherwise(F.regexp_extract(r, "^&#0*([0-9]{1,9});", 1)), F.lit("")).cast("long"), F.lit(0))
    letter = lambda n: F.when((n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("\ufffd")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"), F.lit(0)))
    pairs = F.transform(found, lambda r: F.struct(r.alias("r"), F.when(r.startswith("&#"), letter(code(r))).otherwise(known[F.substring(r, 2, 100)]).alias("c")))
    # what stands for & comes last, so that nothing is decoded twice
    usable = F.filter(pairs, lambda p: p["c"].isNotNull() & (p["c"] != "&"))
    out = F.aggregate(usable, text, lambda t, p: F.replace(t, p["r"], p["c"]))
    return F.regexp_replace(out, "&(?:amp|AMP|#0*38|#[xX]0*26);", "&")


def html_to_text(markup: Column) -> Column:
    """Readable text of HTML: script-like elements go, block elements end lines, all character references are decoded."""
    out = F.regexp_replace(markup, r"(?is)<!--.*?-->|<(script|style|head|noscript|template)\b.*?</\1\s*>", "")
    out = F.regexp_replace(out, r"(?i)</?(p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|blockquote|pre)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    out = decoded(out)
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\r\f\xA0]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{2,}", "\n"), r"^\s+|\s+$", "")


def looks_like_html(name: Column, content_type: Column, body: Column) -> Column:
    head = F.lower(F.substring(body, 1, 512))
    return F.lower(name).rlike(r"\.html?$") | F.contains(F.lower(content_type), F.lit("text/html")) | F.contains(head, F.lit("<!doctype html")) | F.contains(head, F.lit("<html"))
