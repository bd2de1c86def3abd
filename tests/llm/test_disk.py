"""What the pipeline and its operators write and shuffle on the way."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from quantloom.llm import common, jaccard_join
from quantloom.llm.suffix_dedup import _shared_anchors
from tests.llm.test_operators import SCHEMA, _odd_rows
from tests.llm.test_passages import _words


def _folders() -> set:
    return {path.rpartition("/")[2].rpartition("-")[0] for _, path in common._WRITTEN.values()}


def test_a_stage_deletes_what_the_one_before_left(spark, sf_dir, tmp_path):
    for frame in common.written():
        common.discard(frame)
    docs = common.documents(spark, sf_dir)
    corpus_pipeline.quality(spark, docs, sf_dir).write.parquet(f"{tmp_path}/0")
    assert "rule-rows" in _folders()
    corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/0"), sf_dir).write.parquet(f"{tmp_path}/1")
    assert "rule-rows" not in _folders() and "numbered-rows" in _folders()
    corpus_pipeline.secrets(spark, spark.read.parquet(f"{tmp_path}/1"), sf_dir)
    assert not _folders()


def test_an_input_that_was_not_written_keeps_what_it_reads(spark, sf_dir):
    good = corpus_pipeline.quality(spark, common.documents(spark, sf_dir), sf_dir)
    clean = corpus_pipeline.secrets(spark, good, sf_dir)
    assert "rule-rows" in _folders() and clean.count() == good.count() > 0


def test_only_the_result_of_a_whole_run_stays(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert not corpus_pipeline._LEFT and id(out) in common._WRITTEN and "numbered-texts" not in _folders()
    assert out.count() > 0


def test_without_keeps_columns_and_rows_and_shuffles_few(spark):
    docs = spark.createDataFrame(_odd_rows(), SCHEMA).selectExpr("text", "lang as `a.b`", "row_number() over (order by doc_id, text) as row")
    docs = common.materialise(docs, "rows")
    for gone in ([], [3], list(range(1, 40))):
        table = common.materialise(spark.createDataFrame([(x,) for x in gone], "row int"), "gone")
        got = jaccard_join.without(docs, table, "row")
        assert got.columns == docs.columns
        assert Counter(map(tuple, got.collect())) == Counter(tuple(r) for r in docs.collect() if r["row"] not in gone)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("LeftAnti") == 1


def test_shared_anchors_with_one_very_common_key(spark):
    rows = [(k % 50, k % 3, k % 2, k, 0) for k in range(60)] + [(7777, k == 5, 0, k, 1) for k in range(3000)] + [(1000 + k, 1, 1, k, 2) for k in range(400)]
    rows = [(k, int(a), b, u, p) for k, a, b, u, p in rows]
    table = common.materialise(spark.createDataFrame(rows, "key long, a0 long, a1 long, uid long, pos int"), "anchors")
    kinds = defaultdict(set)
    for k, a, b, _, _ in rows:
        kinds[k].add((a, b))
    times = Counter(r[0] for r in rows)
    want = Counter((*r, len(kinds[r[0]]) > 1) for r in rows if times[r[0]] > 1)
    for parts in (2000, 5, 1):
        got = _shared_anchors(table, parts)
        assert got.columns == [*table.columns, "differ"] and Counter(map(tuple, got.collect())) == want
    plan = _shared_anchors(table, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("LeftAnti") == 1
    assert _shared_anchors(table.where("key < 0")).count() == 0


def test_components_are_joined_once_a_turn(spark, monkeypatch):
    """Rows of large keys meet the components known so far in one join, not in one for each reader."""
    texts = [(k, " ".join([*_words(k // 6, 60), f"x{k}"])) for k in range(36)]
    plans, write = [], common.materialise

    def watched(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(common, "materialise", watched)
    settings = jaccard_join.JaccardSettings(frequent_share=0.0, very_share=0.0, least_frequent=2, least_very=3, few=2, pivots=1)
    jaccard_join.jaccard_groups(spark.createDataFrame(texts, "doc_id long, text string"), settings).collect()
    assert [p for name, p in plans if name == "open-keys"] and all(p.count("LeftOuter") == 0 for name, p in plans if name == "open-keys")
