"""Glossary terms and entity names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import entity_candidates, jaccard, names_token, norm_key, trigram_set
from brindle.session import stage

from .ranking import first_by, top_by

#: Nodes that rank_entities gives for an asked text.
CANDIDATES = 200


def aliases(glossary: DataFrame) -> DataFrame:
    """alias, term and category: every term is its own alias, and a term is never another's synonym."""
    terms = glossary.select(F.col("term").alias("alias"), "term", "category").distinct()
    others = glossary.select(F.explode("synonyms").alias("alias"), "term", "category").where("alias <> ''").distinct()
    return terms.unionByName(others.join(terms.select("alias").distinct(), "alias", "left_anti"))


def claims(alias_table: DataFrame) -> DataFrame:
    """Per normalised key the terms that claim it; usable if there is one."""
    keyed = alias_table.withColumn("key", norm_key(F.col("alias"))).where("key <> ''")
    return keyed.groupBy("key").agg(F.array_sort(F.collect_set("term")).alias("terms")).withColumn("usable", F.size("terms") == 1)


def resolve(names: DataFrame, alias_table: DataFrame) -> DataFrame:
    """names (column name) with their term: by exact alias, else by normalised key, else the name itself."""
    exact = alias_table.groupBy("alias").agg(F.min("term").alias("_t"), F.countDistinct("term").alias("_n")).where("_n = 1").select(F.col("alias").alias("name"), F.col("_t").alias("_exact"))
    loose = claims(alias_table).where("usable").select(F.col("key").alias("_key"), F.col("terms")[0].alias("_loose"))
    joined = names.withColumn("_key", norm_key(F.col("name"))).join(exact, "name", "left").join(loose, "_key", "left")
    return joined.withColumn("term", F.coalesce("_exact", "_loose", "name")).drop("_key", "_exact", "_loose")


def expand(names: DataFrame, glossary: DataFrame) -> DataFrame:
    """Resolved names with all their forms: the term and its synonyms."""
    forms = glossary.select("term", F.array_distinct(F.concat(F.array("term"), "synonyms")).alias("forms"))
    return names.join(forms, "term", "left").withColumn("forms", F.coalesce("forms", F.array("term")))


def in_category(alias_table: DataFrame, category: str) -> DataFrame:
    return alias_table.where(F.col("category") == category)


def categories(alias_table: DataFrame) -> DataFrame:
    return alias_table.groupBy("category").agg(F.countDistinct("term").alias("terms"))


RUN = r"[\p{L}\p{N}]+"


def _pieces(text: Column, wanted: DataFrame) -> Column:
    """The distinct pieces of text that are as long as some wanted text (column _piece). The lengths are few: a job finds them."""
    lengths = sorted(r[0] for r in wanted.select(F.length("_piece")).distinct().collect())
    size = F.length(text)
    of_length = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: text.substr(i, F.lit(n)))).otherwise(F.array())
    return F.array_distinct(F.flatten(F.array(*map(of_length, lengths)))) if lengths else F.array().cast("array<string>")


ASCII_NAME = "^[A-Za-z0-9_-]+$"


def _longest(parts: Column) -> Column:
    """The longest of the parts, with its number from 0; null if there is none."""
    return F.array_max(F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), p.alias("p"), i.alias("i"))))


def _anchors(names: DataFrame) -> DataFrame:
    """name, _piece (its longest run), _at and _sure (whether a text with the piece there holds the name).

    A purely ASCII name touches no ASCII letter or digit, so each of its ASCII runs is a whole one (part). Another name's runs are whole
    ones inside it (run), ends of one where it begins with a run (tail) and beginnings where it ends with one (head); a name that is a
    run may lie anywhere in one (inner).
    """
    each = names.select("name").distinct()
    parts = lambda pattern: F.regexp_extract_all("name", F.lit(pattern), F.lit(0))
    ascii_ones = each.where(F.col("name").rlike(ASCII_NAME)).select("name", parts("[A-Za-z0-9]+").alias("_p"))
    ascii_ones = ascii_ones.select("name", _longest(F.col("_p")).alias("_l"), F.lit("part").alias("_at"))
    others = each.where(~F.col("name").rlike(ASCII_NAME)).select("name", parts(RUN).alias("_p")).select("name", "_p", _longest(F.col("_p")).alias("_l"))
    begins = (F.col("_l.i") == 0) & F.col("name").rlike(f"^{RUN}")
    ends = (F.col("_l.i") == F.size("_p") - 1) & F.col("name").rlike(rf"{RUN}\z")
    others = others.select("name", "_l", F.when(begins & ends, "inner").when(begins, "tail").when(ends, "head").otherwise("run").alias("_at"))
    return ascii_ones.unionByName(others).where("_l IS NOT NULL").select("name", F.col("_l.p").alias("_piece"), "_at", (F.col("_l.p") == F.col("name")).alias("_sure"))


def named(texts: DataFrame, names: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and name wherever text holds name: anywhere in it, but that a purely ASCII name touches no other ASCII letter or digit.

    A text that holds a name holds the name's longest run of letters and digits in one of its own runs. So the runs of all texts make
    a vocabulary, whose words are cut into the pieces that names can have there, and the pieces are matched by equality; texts meet names
    through the few words that matched. A name that is one run is found by that; for the rest a text is looked at once, with all of its
    names. Names without a letter or digit name nothing.
    """
    anchors = stage(_anchors(names), "anchors")
    runs = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)))).alias("_run"))
    word, size = F.col("_run"), F.length("_run")
    lengths: dict[str, list[int]] = {}
    for row in anchors.select("_at", F.length("_piece").alias("n")).distinct().orderBy("n").collect():
        lengths.setdefault(row["_at"], []).append(row["n"])
    cut = lambda at, piece: F.array(*[F.when(size >= n, piece(n)) for n in lengths.get(at, [])]).cast("array<string>")
    pieces = {
        "part": F.regexp_extract_all(word, F.lit("[A-Za-z0-9]+"), F.lit(0)), "run": F.array(word), "inner": _pieces(word, anchors.where("_at = 'inner'")),
        "tail": cut("tail", lambda n: F.right(word, F.lit(n))), "head": cut("head", lambda n: F.left(word, F.lit(n))),
    }
    placed = lambda at: F.transform(F.array_distinct(pieces[at]), lambda p: F.struct(F.lit(at).alias("_at"), p.alias("_piece")))
    spread = F.flatten(F.array(*map(placed, pieces)))
    vocabulary = runs.select("_run").distinct().select("_run", F.inline(spread)).where("_piece IS NOT NULL")
    matched = stage(vocabulary.join(anchors, ["_at", "_piece"]).groupBy("_run").agg(F.collect_list(F.struct("name", "_sure")).alias("_names")), "matched")
    found = runs.join(matched, "_run").select(key, F.inline("_names")).distinct()
    asked = found.where("NOT _sure").groupBy(key).agg(F.collect_list("name").alias("_names"))
    looked = texts.select(key, F.col(text).alias("_text")).join(asked, key).select(key, F.explode(F.filter("_names", lambda n: names_token(F.col("_text"), n))).alias("name"))
    return found.where("_sure").select(key, "name").unionByName(looked.distinct())


def names_in_text(texts: DataFrame, names: DataFrame, key: str, text: str = "text", limit: int = 30) -> DataFrame:
    """key, name and rank of the names that a text holds, longest first."""
    return top_by(named(texts, names, key, text), [key], limit, F.desc(F.length("name")), F.asc("name"))


def holders(rows: DataFrame, wanted: DataFrame, fold: Callable[[Column], Column] = norm_key, text: str = "asked") -> DataFrame:
    """rows (column name), each with every asked text (column asked) whose folded form its name's holds, and how closely: tier 0 for
    the same, 1 for a beginning, 2 for another place. Found by pieces of equal length; the rows stay where they are. text: the column
    of wanted that is looked for, if it is another spelling of asked; a row comes once for each that it holds."""
    asked = wanted.select("asked", fold(F.col(text)).alias("_piece")).where("_piece <> ''").distinct()
    keyed = rows.withColumn("_key", fold(F.col("name")))
    found = keyed.withColumn("_piece", F.explode(_pieces(F.col("_key"), asked))).join(asked, "_piece")
    tier = F.when(F.col("_key") == F.col("_piece"), 0).when(F.startswith("_key", "_piece"), 1).otherwise(2)
    return found.withColumn("tier", tier.cast("long")).drop("_key", "_piece")


def holding(names: DataFrame, wanted: DataFrame, fold: Callable[[Column], Column] = norm_key) -> DataFrame:
    """Pairs of a name and an asked text (column asked) whose folded form the name's holds."""
    return holders(names.select("name").distinct(), wanted, fold).select("asked", "name")


def rank_entities(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of each asked text the first 200 nodes (name, label, degree) that hold it: exact before prefix before substring, then degree, length and name."""
    order = (F.asc("tier"), F.desc("degree"), F.asc(F.length("name")), F.asc("name"), F.asc("label"))
    return top_by(holders(nodes.select("name", "label", "degree"), wanted), ["asked"], CANDIDATES, *order)


def lookup_entities(wanted: DataFrame, nodes: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """Of each asked name the node it means: asked, name, label, and all types and names of that node's spellings.

    nodes: name, label, degree. forms: asked and form, the spellings to look for (None: the asked name alone). A node comes before
    another that matches less closely by any form, then by degree, length, name and label; nodes whose names differ from the first
    one's in spelling only are the same thing, and are told together.
    """
    spelled = forms if forms is not None else wanted.select("asked", F.col("asked").alias("form"))
    # all nodes that hold a form are ranked: a node that holds several has its closest one before the others
    order = (F.asc("tier"), F.desc("degree"), F.asc(F.length("name")), F.asc("name"), F.asc("label"))
    best = first_by(holders(nodes.select("name", "label", "degree"), spelled, text="form"), ["asked"], *order)
    best = stage(best.select("asked", "name", "label", norm_key(F.col("name")).alias("_key")), "best")
    # a node spelled like the first one holds what that holds
    alike = nodes.select(norm_key(F.col("name")).alias("_key"), F.col("name").alias("_name"), F.col("label").alias("_label")).join(best, "_key")
    return alike.groupBy("asked", "name", "label").agg(F.array_sort(F.collect_set("_label")).alias("types"), F.array_sort(F.collect_set("_name")).alias("names"))


def entities_in_questions(questions: DataFrame, names: DataFrame, key: str, limit: int = 5) -> DataFrame:
    """key, name and rank: the names that a question holds, longest first; where it holds none of two letters and more, names that
    hold one of its words without particle, two a word (the first by name), in the words' order."""
    exact = top_by(named(questions, names.where("length(name) >= 2"), key), [key], limit, F.desc(F.length("name")), F.asc("name"))
    rest = questions.join(exact.select(key).distinct(), key, "left_anti")
    words = rest.select(key, F.posexplode(entity_candidates(F.col("text"))).alias("_at", "_piece"))
    spread = names.select("name").distinct().select("name", F.explode(_pieces(F.col("name"), words)).alias("_piece"))
    held = top_by(words.join(spread, "_piece"), [key, "_at"], 2, F.asc("name")).groupBy(key, "name").agg(F.min(F.struct("_at", "rank")).alias("_o"))
    loose = top_by(held, [key], limit, F.asc("_o"), F.asc("name")).select(key, "name", "rank")
    return exact.select(key, "name", "rank").unionByName(loose)


def duplicate_names(nodes: DataFrame) -> DataFrame:
    """Names with several labels, and normalised keys with several spellings."""
    labels = nodes.groupBy("name").agg(F.array_sort(F.collect_set("label")).alias("found")).where("size(found) > 1").select(F.lit("labels").alias("problem"), F.col("name").alias("key"), "found")
    spelled = nodes.withColumn("key", norm_key(F.col("name"))).groupBy("key").agg(F.array_sort(F.collect_set("name")).alias("found")).where("size(found) > 1").select(F.lit("spellings").alias("problem"), "key", "found")
    return labels.unionByName(spelled)


def similar_names(nodes: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Pairs of distinct names whose trigram sets are alike.

    Only names that share one of their rarest trigrams are compared: two sets with similarity t share one among the first
    size - ceil(t * size) + 1 of each, in a common order by frequency.
    """
    sets = nodes.select("name").distinct().withColumn("s", trigram_set(F.lower("name")))
    spread = sets.withColumn("g", F.explode("s"))
    counts = spread.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    ordered = spread.join(counts, "g").groupBy("name", "s").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("o"))
    prefix = ordered.select("name", "s", F.explode(F.slice("o", 1, F.size("o") - F.ceil(F.size("o") * threshold).cast("int") + 1)).alias("x")).select("name", "s", F.col("x.g").alias("g"))
    other = prefix.select(F.col("name").alias("other"), F.col("s").alias("t"), "g")
    pairs = prefix.join(other, "g").where("name < other").select("name", "other", "s", "t").dropDuplicates(["name", "other"])
    return pairs.withColumn("similarity", jaccard(F.col("s"), F.col("t"))).where(F.col("similarity") >= threshold).select("name", "other", "similarity")


def affix_pairs(names: DataFrame, suffix: bool = False, extra: int | None = None) -> DataFrame:
    """Pairs short, long where the long name's key begins (or ends) with the short one's.

    Every prefix (suffix) of a key is spelled out and matched by equality: linear in the letters, not all pairs.
    """
    keyed = names.select("name", norm_key(F.col("name")).alias("key")).where("length(key) >= 2").distinct()
    cuts = F.sequence(F.lit(2), F.length("key") - 1)
    part = (lambda i: F.col("key").substr(F.length("key") - i + 1, i)) if suffix else (lambda i: F.col("key").substr(F.lit(1), i))
    parts = keyed.where("length(key) > 2").select(F.col("name").alias("long"), F.length("key").alias("_n"), F.explode(F.transform(cuts, part)).alias("key"))
    pairs = parts.join(keyed.select(F.col("name").alias("short"), "key"), "key")
    if extra is not None:
        pairs = pairs.where(F.col("_n") - F.length("key") <= extra)
    return pairs.select("short", "long").distinct()


def first_node_of(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each name with one node: the first by label."""
    return names.join(first_by(nodes, ["name"], F.asc("label")), "name", "left")


def to_do(nodes: DataFrame, alias_table: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """What a glossary still lacks, as rows (problem, key, found): aliases of several terms, names of several labels or spellings,
    names that shorten another, and names with one of the labels that no alias covers."""
    row = lambda df, problem, key, found: df.select(F.lit(problem).alias("problem"), F.col(key).alias("key"), found.alias("found"))
    conflicts = row(claims(alias_table).where("size(terms) > 1"), "conflict", "key", F.array_join("terms", ","))
    double = duplicate_names(nodes).withColumn("found", F.array_join("found", ",")).select("problem", "key", "found")
    short = row(affix_pairs(nodes.select("name").distinct()), "abbreviation", "short", F.col("long"))
    wanted = nodes.where(F.col("label").isin(*labels)).select("name", "label").distinct().withColumn("_key", norm_key(F.col("name")))
    open_ones = wanted.join(alias_table.select(norm_key(F.col("alias")).alias("_key")).distinct(), "_key", "left_anti")
    return conflicts.unionByName(double).unionByName(short).unionByName(row(open_ones, "unregistered", "name", F.col("label")))
