"""URL filter by empirical-Bayes host reputation, in DataFrame functions only.

A page's outcome is the quality label of the document that its url names (the number that ends the path): 0 counts as bad.
Counts of bad and labelled pages are summed per host, registered domain and suffix. Each level gets a beta prior centred on
the level above, whose strength comes from the method of moments over its children (beta-binomial overdispersion). A host is
blocked where even the lower posterior bound of its bad share, a normal bound on the log-odds with the exact posterior mean
and variance of the logit, lies over BAD_SHARE. Fixed rules come first.

Suffixes are a parameter in the format of the public suffix list (rules, *. wildcards, ! exceptions, // comments); without a rule the
last label is the suffix. User names, ports and dots at the end are no part of a domain; numeric addresses are domains of their own
under one suffix.

Defined results: null urls and urls without "://" have empty host and path, belong to the empty host, and fit no rule; hosts
without labelled pages are judged by their priors; repeated pages count as often as they occur in pages; a document labelled
twice is bad if any label says so; without any labels every page that no rule fits is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage
from .stats_sql import digamma, trigamma

#: Rule -> verdict; a rule is host + path.
RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}
BAD_SHARE, BOUND_Z = 0.5, 1.6449
#: Limits of a prior's strength, in pages, and the strength where a group has no labels.
WEAKEST, STRONGEST, UNKNOWN = 1.0, 200.0, 10.0
#: The suffix rules where no list is given: a few common ones of two labels. Labels of a suffix at most.
SUFFIXES = "co.uk\norg.uk\nac.uk\ncom.au\nco.jp\ncom.br\nco.nz\n*.ck\n!www.ck"
LABELS = 5
#: Numeric addresses, of either version.
ADDRESS = r"^(?:[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+|\[.*\])$"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parse(pages: DataFrame) -> DataFrame:
    """page_id, url and its host, path and rule."""
    url = F.coalesce(F.col("url"), F.lit(""))
    parsed = pages.select("page_id", "url", ascii_lower(F.regexp_extract(url, URL, 1)).alias("host"), F.regexp_extract(url, URL, 2).alias("path"))
    rule = F.lit(None).cast("string")
    for name in sorted(RULES, key=len):  # later conditions go outside: the longest wins
        host, path = name.split("/", 1)
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule = F.when(fits, F.lit(name)).otherwise(rule)
    return parsed.withColumn("rule", rule)


def _strength(n: str, k: str, children: str, squares: str) -> Column:
    """Strength of the children's beta prior, from sums over them: squares is the sum of k * k / n."""
    m = f"({k} / {n})"
    rho = f"((({squares}) - {k} * {m}) / ({m} * (1 - {m})) - ({children} - 1)) / greatest({n} - {children}, 1)"
    return F.expr(
        f"CASE WHEN coalesce({n}, 0) = 0 THEN {UNKNOWN}D WHEN {k} = 0 OR {k} = {n} THEN {STRONGEST}D"
        f" ELSE least(greatest(1 / greatest({rho}, 1e-9D) - 1, {WEAKEST}D), {STRONGEST}D) END"
    )


def _up(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("k").alias("k"),
        F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("c"),
        F.sum(F.when(F.col("n") > 0, F.col("k") * F.col("k") / F.col("n")).otherwise(0.0)).alias("q"),
    )


def parse_suffixes(text: str) -> tuple[set[str], set[str], set[str]]:
    """Rules of a public suffix list: exact ones, parents of wildcards, exceptions."""
    rules = {line.split()[0].lower() for line in text.splitlines() if line.strip() and not line.strip().startswith("//")}
    exceptions = {r[1:] for r in rules if r.startswith("!")}
    parents = {r[2:] for r in rules if r.startswith("*.")}
    return {r for r in rules if r[0] not in "!*"}, parents, exceptions


def domains(hosts: DataFrame, suffixes: str = SUFFIXES) -> DataFrame:
    """hosts with the registered domain and the suffix of each host added."""
    exact, parents, exceptions = parse_suffixes(suffixes)
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", ""), "[.]+$", "")
    named = hosts.withColumn("_name", name).withColumn("_labels", F.split("_name", "[.]"))
    size = F.size("_labels")
    last = lambda m: F.array_join(F.slice("_labels", F.greatest(size - m + 1, F.lit(1)), m), ".")
    depth = F.lit(1)
    for m in range(1, LABELS + 1):  # later conditions go outside: the longest wins, and an exception before all
        depth = F.when((size >= m) & (last(m).isin(*exact) | (last(m - 1).isin(*parents) if m > 1 else F.lit(False))), F.lit(m)).otherwise(depth)
    for m in range(1, LABELS + 1):
        depth = F.when((size >= m) & last(m).isin(*exceptions), F.lit(m - 1)).otherwise(depth)
    named = named.withColumn("_depth", depth)
    address = F.col("_name").rlike(ADDRESS)
    cut = named.withColumn("domain", F.when(address, F.col("_name")).otherwise(last(F.col("_depth") + 1)))
    return cut.withColumn("suffix", F.when(address, "#").otherwise(last(F.col("_depth")))).drop("_name", "_labels", "_depth")


def reputation(outcomes: DataFrame, suffixes: str = SUFFIXES) -> DataFrame:
    """outcomes: host and bad (null: not labelled), a row per page. Returns per host n, k, bound and blocked."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum(F.col("bad").cast("int")), F.lit(0)).cast("double").alias("k"))
    hosts = domains(hosts, suffixes)
    per_domain = _up(hosts, "domain", "suffix")
    per_suffix = _up(per_domain, "suffix")
    top = _up(per_suffix)
    whole = top.select(F.struct(F.expr("coalesce(k, 0) + 0.5").alias("a"), F.expr("coalesce(n, 0) + 1").alias("b"), _strength("n", "k", "c", "q").alias("s"))).scalar()
    suffix_means = per_suffix.withColumn("_w", whole).select("suffix", F.expr("(k + _w.s * _w.a / _w.b) / (n + _w.s)").alias("sm"), _strength("n", "k", "c", "q").alias("ss"))
    domain_means = per_domain.join(suffix_means, "suffix").select("domain", F.expr("(k + ss * sm) / (n + ss)").alias("dm"), _strength("n", "k", "c", "q").alias("ds"))
    a, b = "(k + ds * dm)", "(n - k + ds * (1 - dm))"
    logit = f"({digamma(a)} - {digamma(b)} - {BOUND_Z}D * sqrt({trigamma(a)} + {trigamma(b)}))"
    scored = hosts.join(domain_means, "domain").withColumn("bound", F.expr(f"1 / (1 + exp(-{logit}))"))
    return scored.select("host", "n", "k", "bound", (F.col("bound") > BAD_SHARE).alias("blocked"))


def judge(pages: DataFrame, labels: DataFrame, suffixes: str = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, host_labelled and host_bad of every page."""
    parsed = parse(pages).withColumn("_doc", F.expr(r"try_cast(nullif(regexp_extract(path, '/([0-9]+)(?:[.]html)?/?$', 1), '') AS BIGINT)"))
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_doc")).agg((F.min("quality") == 0).alias("bad"))
    # staged: Spark then broadcasts the hosts if they are small, and can split a host of very many pages if they are not
    hosts = stage(reputation(parsed.select("host", "_doc").join(marked, "_doc", "left").select("host", "bad"), suffixes), "hosts")
    joined = parsed.join(hosts, "host", "left")
    ruled = F.when(F.col("rule").isin(*[r for r, v in RULES.items() if v == "block"]), "block").otherwise("allow")
    verdict = F.when(F.col("rule").isNotNull(), ruled).when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("n").cast("long").alias("host_labelled"), F.col("k").cast("long").alias("host_bad"))
