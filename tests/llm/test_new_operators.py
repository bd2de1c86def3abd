"""Whitening, fill-in-middle and the quality classifier against plain versions and over odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from quantloom.llm import common, packing, quality_classifier, queries
from quantloom.llm.fill_in_middle import ClassRuns, MiddleSettings, fill_in_middle, middle_report
from quantloom.llm.quality_classifier import CompressionModel, CompressionSettings, classify_quality, train
from quantloom.llm.whitening import WhiteningSettings, fit_whitening, jacobi_svd, whitening_report
from tests import oracle
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, _by_id, _odd_rows, _pandas, docs, tables  # noqa: F401

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def _middle(doc, text: str | None) -> tuple:
    text = text or ""
    h = hashlib.sha256(f"1:{doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNITS.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, len(units), "plain", None, None, brute.sha(text.encode()), brute.sha(text.encode())
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return doc, len(units), "spm" if h4 % 100 < 20 else "psm", len(p), len(m), brute.sha(out.encode()), brute.sha(text.encode())


def test_fill_in_middle(docs):  # noqa: F811
    source = _pandas(docs)
    want = [_middle(d, t) for d, t in zip(source["doc_id"], source["text"], strict=True)]
    assert _by_id([tuple(r) for r in middle_report(docs).collect()]) == _by_id(want)


def test_fill_in_middle_marks_and_borders(spark):
    texts = ["a<P>b", "<S>", "x <M> y", "<<", "<S", "S>", "<", ">", "P><M", "1", "é", "aé1b", "\U0001f642" * 7 + "ab", "ab cd\n\tef", "<P", "\x00", "<<<P"]
    rows = [(i + 100 * k, t) for k in range(12) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([*rows, (None, "null id")], "doc_id long, text string")
    got = middle_report(frame).collect()
    assert _by_id([tuple(r) for r in got if r["doc_id"] is not None]) == _by_id([_middle(d, t) for d, t in rows])
    (lost,) = [r for r in got if r["doc_id"] is None]
    assert lost["restored_sha256"] == brute.sha(b"null id")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_other_marks(spark):
    s = MiddleSettings(prefix="[pre]", suffix="[suf]", middle="[mid]", cut_percent=100, spm_percent=50, seed=9)
    frame = spark.createDataFrame([(i, f"word {i}, and <P> more ü") for i in range(40)], "doc_id long, text string")
    got = fill_in_middle(frame, s).collect()
    assert {r["form"] for r in got} == {"psm", "spm"}
    assert all(brute.sha(f"word {r['doc_id']}, and <P> more ü".encode()) == r["restored_sha256"] for r in middle_report(frame, s).collect())


@pytest.mark.parametrize("text", ["", "a", "1", "ab1", "1ab", "a1b22cc333", "ü", "aüb", "\U0001f642a"])
def test_class_runs_place_every_unit(text):
    runs, at = ClassRuns(text), 0
    for u, unit in enumerate(UNITS.findall(text)):
        assert runs.place(u) == at
        at += len(unit)
    assert runs.place(runs.n) == at == len(text)


def test_fill_in_middle_same_as_sql(spark, sf_dir):
    oracle.assert_same(queries.QUERIES["op12_fill_in_middle"](spark, sf_dir).toPandas(), oracle.connect(sf_dir).execute(queries.ORACLES["op12_fill_in_middle"]).df())


def _whitened(vectors: list, k: int = 8) -> dict:
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    y = n * x - sums
    centred = y / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return {"n": n, "deviation": [sum(int(i) ** 2 for i in row) for row in y], "whitened": (centred @ v[:, :k]) / np.sqrt(e[:k]), "explained": e[:k] / e.sum(), "components": v[:, :k]}


def _check_whitening(got: pd.DataFrame, ids: list, vectors: list, k: int) -> None:
    want = _whitened(vectors, k)
    assert len(got) == len(ids) * k and set(got["n"]) == {want["n"]} and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] <= 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids]
    assert list(wide.columns) == list(range(1, k + 1))
    sign = np.sign((wide.to_numpy() * want["whitened"]).sum(axis=0))
    assert np.allclose(wide.to_numpy() * sign, want["whitened"], atol=1e-8)
    one = got[got["component"] == 1].set_index("vec_id").loc[ids]
    assert [int(d) for d in one["deviation"]] == want["deviation"]
    assert np.allclose(got.drop_duplicates("component").sort_values("component")["explained"], want["explained"], rtol=1e-9)


def test_whitening_whole_table(spark, sf_dir):
    rows = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    _check_whitening(queries.QUERIES["op11_embedding_whitening"](spark, sf_dir).toPandas(), list(rows["vec_id"]), list(rows["embedding"]), 8)


@pytest.mark.parametrize("stacked", [8_000_000, 2 * 6 * 6])
def test_whitening_odd_rows(spark, stacked):
    r = np.random.default_rng(3)
    good = [list(map(float, np.float32(v))) for v in r.normal(0, 1, (300, 6)) * [5, 4, 3, 2, 1, 0.5]]
    good += [good[0]] * 150  # a third of the rows are one vector
    bad = [None, [], [1.0], [1.0] * 7, [None, *good[0][1:]], [float("nan")] * 6, [float("inf"), *good[0][1:]], [1e30, *good[0][1:]]]
    rows = [(i, v, 1, "x") for i, v in enumerate(good + bad)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int, whitened string").repartition(13)
    got = whitening_report(frame, WhiteningSettings(rows=7, stacked=stacked)).toPandas()
    _check_whitening(got, list(range(len(good))), good, 6)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening_report(spark.createDataFrame([], schema)).count() == 0
    assert whitening_report(spark.createDataFrame([(1, None), (2, [None])], schema)).count() == 0
    one = whitening_report(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).toPandas()
    assert len(one) == 6 and set(one["whitened"]) == {0.0} and set(one["deviation"]) == {0} and set(one["explained"]) == {0.0} and set(one["identity_error"]) == {0.0}
    line = whitening_report(spark.createDataFrame([(i, [float(i), float(2 * i)]) for i in range(5)], schema)).toPandas()
    assert set(line[line["component"] == 2]["whitened"]) == {0.0} and line["identity_error"].max() < 1e-12
    assert np.isclose(line[line["component"] == 1]["whitened"].abs().max(), np.sqrt(2))


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(i, [float((-1) ** i * 2**40), 1.0]) for i in range(4)]
    got = whitening_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert got["deviation"].isna().all() and np.allclose(got[got["component"] == 1]["whitened"].abs(), 1)


@pytest.mark.parametrize("d", [1, 2, 5, 33])
def test_jacobi_against_the_library(d):
    r = np.random.default_rng(d)
    a = r.normal(size=(d, d)) @ np.diag(10.0 ** -np.arange(d) if d < 9 else r.uniform(0.5, 2, d))
    sizes, v = jacobi_svd(a)
    assert np.allclose(sizes, np.linalg.svd(a, compute_uv=False), rtol=1e-10) and np.allclose(v.T @ v, np.eye(d), atol=1e-13)
    assert np.allclose((a @ v).T @ (a @ v), np.diag(sizes**2), atol=1e-12 * sizes[0] ** 2)


def test_fit_says_what_it_fitted(spark):
    r = np.random.default_rng(1)
    frame = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(r.normal(size=(50, 3)))], "vec_id long, embedding array<double>")
    model = fit_whitening(frame, WhiteningSettings(components=2))
    assert model.n == 50 and model.dims == 3 and model.components.shape == (3, 2) and sum(model.explained) < 1


def test_quality_classifier_on_held_out_labels(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest table has only 19 held-out labels
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet").set_index("doc_id")["quality"]
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_quality_classifier"](spark, sf_dir).collect()}
    assert len(got) == common.documents(spark, sf_dir).count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    tested = [i for i in labels.index if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == labels[i] for i in tested) >= 0.9 * len(tested)
    good, bad = ([got[i]["score"] for i in tested if labels[i] == y] for y in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) >= 0.9


def test_quality_classifier_never_reads_held_out_labels(spark, sf_dir):
    docs_, labels = common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("quality", (1 - labels["quality"]).cast("int")).where(quality_classifier.held_out("doc_id"))
    other = labels.where(~quality_classifier.held_out("doc_id")).unionByName(turned)
    a, b = (_by_id([tuple(r) for r in classify_quality(docs_, train(docs_, x)).collect()]) for x in (labels, other))
    assert a == b


def test_quality_classifier_odd_rows(spark, sf_dir):
    docs_, labels = common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs_, labels)
    odd = spark.createDataFrame(_odd_rows(), SCHEMA).withColumnRenamed("key", "score").withColumnRenamed("uid", "predicted")
    got = classify_quality(odd, model).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in _odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[0] == by[1] and by[6] == by[7]  # null as empty, equal texts alike
    assert classify_quality(odd.limit(0), model).count() == 0


def test_quality_classifier_labels_that_teach_nothing(spark):
    docs_ = spark.createDataFrame([(i, f"some text number {i}") for i in range(40)] + [(None, None), (3, None)], "doc_id long, text string")
    for rows, share in ([], 0.5), ([(i, 1) for i in range(40)], 1.0), ([(None, 1), (4, None), (6, 7)], 0.5), ([(i, y) for i in range(40) for y in (0, 1)], 0.5):
        got = classify_quality(docs_, train(docs_, spark.createDataFrame(rows, "doc_id long, quality int"))).collect()
        assert len(got) == 42 and {r["score"] for r in got} == {share}


def test_whole_texts_are_scored():
    good, bad = [f"the quick brown fox number {i} went over the lazy dog and home again" for i in range(300)], [f"$$$ ### {i} %%% &&& *** !!! @@@ {i * 7} ~~~" for i in range(300)]
    model = CompressionModel(CompressionSettings(block=64)).fit(good + bad, [1] * 300 + [0] * 300, 0.5)
    head, tail = " ".join(good), " ".join(bad)
    scores = model.score([head, head + tail * 3, tail])
    assert scores[0] > 0.9 > 0.5 > scores[1] >= scores[2]


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_places_large_pieces_by_configurations(seed):
    """No more sequences than plain best fit needs; every piece once; large ones all from configurations."""
    r = np.random.default_rng(seed)
    lengths: dict[int, int] = {}
    for x in [*r.integers(1, 1025, 3000), *[1024] * 500, *r.integers(1, 60, 400)]:
        lengths[int(x)] = lengths.get(int(x), 0) + 1
    bins = packing.plan_bins(lengths, 1024)
    held: dict[int, int] = {}
    for n, content in bins:
        assert sum(a * k for a, k in content) <= 1024
        for a, k in content:
            held[a] = held.get(a, 0) + n * k
    assert held == lengths
    used = sum(n for n, _ in bins)
    total = sum(a * n for a, n in lengths.items())
    assert -(-total // 1024) <= used <= sum(n for n, _ in packing.best_fit([], dict(lengths), 1024))


def test_grouping_rounds_up_within_groups_of_equal_size():
    groups = packing.group_up({100: 3, 90: 2, 80: 4, 10: 1}, 5)
    assert groups == {100: [(100, 2), (100, 1), (90, 1)], 90: [(90, 1), (80, 1)], 80: [(80, 2), (80, 1), (10, 1)]}
    plan = packing.configurations({100: [(100, 3)], 60: [(60, 2)], 40: [(40, 2)]}, 100)
    assert sorted((n, sorted(u.items())) for n, u in plan) == [(2, [(40, 1), (60, 1)]), (3, [(100, 1)])]


def test_every_rank_lies_in_one_placement_of_its_block():
    r = np.random.default_rng(2)
    lengths = {int(a): int(n) for a, n in zip(r.choice(1024, 300, replace=False) + 1, r.integers(1, 400, 300), strict=True)} | {1024: 5000}
    places = packing.placements(packing.plan_bins(lengths, 1024))
    width, rows = packing.in_rank_blocks(places)
    assert len(rows) <= 2 * len(places) + len(lengths)
    by: dict[tuple, list] = {}
    for length, block, first, n, *_ in rows:
        by.setdefault((length, block), []).append((first, n))
    for length, n in lengths.items():
        for rank in range(n):
            assert sum(first <= rank < first + k for first, k in by[length, rank // width[length]]) == 1
