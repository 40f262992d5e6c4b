"""The pipeline's stages, and the registered queries, over small tables."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from brindle.llm import decontam, secret_scan, simhash_dedup
from brindle.llm.common import table
from brindle.llm.queries import QUERIES


def test_stages_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.count()
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, sf_dir)
        assert out.columns == columns, name
        rows = out.collect()
        kept = {r.doc_id for r in rows}
        assert kept <= {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            assert 0.5 * before < len(rows) < before
        if name == "simhash_dedup":
            assert kept == {r.component_id for r in simhash_dedup.near_duplicates(docs).collect()}
        if name == "decontamination":
            held = {r.doc_id for r in decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).collect()}
            assert kept == {r.doc_id for r in docs.collect()} - held
        if name == "secrets":
            assert len(rows) == docs.count() and not any(secret_scan.base_spans(r.text or "") for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    tokens = corpus_pipeline.sentencepiece(spark, docs, sf_dir)
    assert tokens.where("round_trip").count() == docs.count() == tokens.count()


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_covers_its_table(spark, sf_dir, name):
    from brindle.llm.queries import ORACLE_SQL

    got = QUERIES[name](spark, sf_dir)
    rows = got.count()
    source = "pages" if name.startswith(("op4", "op7", "op9")) else "documents"
    assert rows == table(spark, sf_dir, source).count() or name.startswith(("op3", "op11", "op12", "op13"))
    assert name not in ORACLE_SQL or ORACLE_SQL[name]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string"


def folder(spark, path, rows, labels=(), items=()):
    """Small tables as a folder of Parquet files."""
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_run_over_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    toxic = [f"{text(20)} vile nasty awful {text(20)}" for _ in range(40)]
    clean = [text(60) for _ in range(80)]
    item = text(25)
    rows = [(i, t, "en", "s", len(t), 0.1, "x") for i, t in enumerate([*toxic, *clean])]
    rows += [(200, clean[0], None, None, None, None, None), (201, f"{text(30)} {item} {text(9)}", "en", "s", 1, 0.9, ""), (202, f"{text(30)} password = Zq9xKv82LmPw77aa {text(9)}", "en", "s", 1, None, "")]
    rows += [(203, None, "en", None, 0, 1.0, ""), (204, "", None, "s", 0, 1.0, ""), (205, " \n\t ", "en", "s", 4, 1.0, ""), (None, text(40), "en", "s", 9, 0.0, ""), (206, text(30), "en", "s", 9, 0.0, ""), (206, text(30), "en", "s", 9, 0.0, "")]
    labels = [(i, 1, int(i < 40)) for i in range(120)] + [(None, 1, 1), (5, None, None)]
    sf = folder(spark, tmp_path / "t", [*rows, rows[-1]], labels, [(1, item), (2, None)])
    docs, kept = table(spark, sf, "documents"), {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(function(spark, docs, sf).collect(), DOCUMENTS)
        kept[name] = Counter(r.doc_id for r in docs.collect())
    assert docs.columns == [c.split()[0] for c in DOCUMENTS.split(", ")]
    assert len(set(kept["toxicity"]) & set(range(40))) <= 2 and set(range(40, 120)) <= set(kept["toxicity"])
    assert 200 not in kept["simhash_dedup"] and kept["simhash_dedup"][206] == 1 and kept["simhash_dedup"][None] == 1
    assert {203, 204, 205} & set(kept["simhash_dedup"]) == {203}  # empty texts are one group
    assert 201 in kept["simhash_dedup"] and 201 not in kept["decontamination"]
    secret = docs.where("doc_id = 202").first()
    assert "Zq9xKv82" not in secret.text and secret.n_chars == len(secret.text)
    tokens = corpus_pipeline.run(spark, sf)
    assert Counter(r.doc_id for r in tokens.collect()) == kept["secrets"] and tokens.where("NOT round_trip").count() == 0


def test_one_row_of_a_group_stays_where_ids_repeat(spark):
    rng = random.Random(3)
    a, b = (" ".join(f"{x}{rng.randrange(900)}" for _ in range(60)) for x in "ab")
    rows = [(i, t, "en", "s", 1, None, None) for i, t in ((5, a), (5, b), (3, b), (7, a), (9, "one text"), (9, "one text"), (None, a))]
    got = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, DOCUMENTS), "")
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(3, b), (5, a), (9, "one text"), (None, a)])


def test_run_over_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "t", [])).count() == 0
    one = folder(spark, tmp_path / "u", [(1, "a b c", "en", "s", 5, 0.0, "")])
    assert corpus_pipeline.run(spark, one).count() == 1
