"""The pipeline's stages, each on its own input."""

import re

import pytest
from pyspark.sql import functions as F

from quaymark.llm import toxicity
from quaymark.llm.common import table
from tests.llm.test_native import brute_exact
from tests.llm.test_repeats import brute_near


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_stages(spark, pipeline, tmp_path):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = docs
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "bpe":
            assert docs.count() == before.count()
            assert docs.join(before.select("doc_id", "text").distinct(), "doc_id").filter("decoded <> text").count() == 0
            continue
        assert docs.columns == columns
        assert docs.exceptAll(before.union(before)).count() == 0
        rows = [(r.doc_id, r.text, r.source) for r in before.select("doc_id", "text", "source").collect()]
        kept = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "toxicity":
            net = toxicity.learn(before, table(spark, d, "labels"))
            want = toxicity.score(before, net).filter("score < 0.7").select("doc_id")
            assert sorted(kept) == sorted(r.doc_id for r in want.collect()) and 0.7 * before.count() < len(kept) < before.count()
        elif name == "exact_dedup":
            assert sorted(kept) == sorted(v[0] for v in brute_exact(rows).values())
        elif name == "near_dedup":
            assert sorted(kept) == sorted(i for i, v in brute_near([(i, t) for i, t, _ in rows], 5).items() if v[2])
        elif name == "mixing":
            assert max(kept.count(i) for i in set(kept)) <= 2
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            total, taken = sum(size(t) for _, t, _ in rows), sum(size(r.text) for r in docs.select("text").collect())
            assert abs(taken - 1.5 * total) < 0.03 * total


CLASHING = "score string, ids string, decoded string, _id int, _toxic int, s string, base int, below string, target string, source_size int, kept string, component_id string, _h int, _hot int, x0 string, sketch string, size string, h string"


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with names that operators use."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, words, "en", "a"), (1, words, "en", "a"), (2, words + " more", "en", "a"), (3, "  " + words.replace(" ", "\n"), None, None), (None, words, "en", "b"), (None, None, None, None), (4, None, "en", "a"), (5, "", "de", "b"), (6, " \t ", "de", "b"),
        (7, "long text " * 40_000, "en", "a"), (8, "x" * 200_000, "en", "c"), (9, "one", "en", None), (10, "one", "fr", "a"), (11, "éñ 日本 \U0001f600", "es", "b")]
    n = CLASHING.count(",") + 1
    df = spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return rows, df.select("*", *(F.lit(str(k)).cast(c.split()[1]).alias(c.split()[0]) for k, c in zip(range(n), CLASHING.split(", ")))).repartition(3)


def test_stages_on_odd_documents(spark, pipeline):
    d = "/root/testdata/sf0.001"
    rows, docs = odd_documents(spark)
    plain = [(i, t, src) for i, t, _, src in rows]
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, d)
        got = out.collect()
        assert stage(spark, docs.limit(0), d).count() == 0
        if name == "bpe":
            assert sorted(((r.doc_id or -1), r.decoded) for r in got) == sorted(((i or -1), t or "") for i, t, _ in plain) and all(len(r.ids) == r.n_tokens for r in got)
            continue
        assert out.columns == docs.columns and out.schema == docs.schema
        ids = sorted(r.doc_id or -1 for r in got)
        if name == "toxicity":
            net = toxicity.learn(docs, table(spark, d, "labels"))
            bad = {r.text for r in toxicity.score(docs, net).filter("score >= 0.7").collect()}
            assert ids == sorted(i or -1 for i, t, _ in plain if t not in bad)
            none = table(spark, d, "labels").limit(0)
            assert toxicity.score(docs, toxicity.learn(docs, none)).filter("score >= 0.7").count() == 0
        elif name == "exact_dedup":
            assert ids == sorted(v[0] or -1 for v in brute_exact(plain).values())
        elif name == "near_dedup":
            kept = {i for i, v in brute_near([(i, t) for i, t, _ in plain if i is not None], 5).items() if v[2]}
            assert ids == sorted(i or -1 for i, _, _ in plain if i is None or i in kept) and ids.count(1) == 2
        else:
            count = lambda i: ids.count(i or -1)
            assert max(map(count, {i for i, _, _ in plain} - {1, None})) <= 2 and count(1) in (0, 2, 4)
            assert sorted(ids) == sorted(r.doc_id or -1 for r in stage(spark, docs.repartition(5), d).collect())


def test_run_gives_the_last_stage(spark, pipeline):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "n_tokens", "ids", "decoded"} <= set(out.columns)
    assert out.filter(F.size("ids") != F.col("n_tokens")).count() == 0 and out.count() > 0
