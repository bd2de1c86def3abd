"""The pipeline's cut of repeated passages, told by words."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from quantloom.llm import common, secret_scan
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, _by_id, _check_packing, _encoded, _odd_rows, _pandas


def _words(seed: int, n: int, most: int = 9) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(1, most))) for _ in range(n)]


def _without_passages(texts: list[str | None], n: int = 51) -> list[str | None]:
    """Each text without the words that lie in a window of n words found at another place too; the
    white space after such a word goes too."""
    words, times = [brute.words(t) for t in texts], Counter()
    for w in words:
        times.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for t, w in zip(texts, words, strict=True):
        gone = {i + k for i in range(len(w) - n + 1) if times[tuple(w[i : i + n])] > 1 for k in range(n)}
        places = [m.span() for m in brute.WORD.finditer(t or "")]
        ends = [b[0] for b in places[1:]] + [places[-1][1]] if places else []
        cut = [(a[0], b) for i, (a, b) in enumerate(zip(places, ends, strict=True)) if i in gone]
        kept, at = "", 0
        for a, b in cut:
            kept, at = kept + t[at:a], b
        out.append(t if not cut else kept + t[at:])
    return out


def test_passages_of_51_short_words_go_and_near_misses_stay(spark):
    passages = [_words(100 + k, 51, most) for k, most in enumerate((1, 2, 3, 9))]  # 101 bytes and more
    near = [_words(200 + k, 50, most) for k, most in enumerate((1, 3, 9, 14))]  # the last has over 400 bytes
    han = ["".join(chr(0x4E00 + x) for x in random.Random(9).sample(range(20_000), 140))]
    texts, seed = {}, 1000
    for k, p in enumerate([*passages, *near, han]):
        for j in range(2):
            texts[10 * k + j] = " ".join([*_words(seed, 40), *p, *_words(seed + 1, 70)])
            seed += 2
    docs = spark.createDataFrame([(i, t, "en", "a", len(t), *[None] * 6) for i, t in texts.items()], SCHEMA)
    got = {r["doc_id"]: r for r in corpus_pipeline.repeated_strings(spark, docs, "").collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        want = " ".join([*t.split()[:40], *t.split()[-70:]]) if i // 10 < len(passages) or i // 10 == 8 else t
        assert (got[i]["text"], got[i]["n_chars"]) == (want, len(want))


@pytest.mark.parametrize("name", ["whole", "odd", "empty"])
def test_passages_against_brute_force(spark, sf_dir, name):
    docs = {"whole": lambda: common.documents(spark, sf_dir), "odd": lambda: spark.createDataFrame(_odd_rows(), SCHEMA), "empty": lambda: spark.createDataFrame([], SCHEMA)}[name]()
    source = _pandas(docs)
    want = list(zip(source["doc_id"], _without_passages(list(source["text"])), strict=True))
    got = corpus_pipeline.repeated_strings(spark, docs, sf_dir)
    assert got.columns == docs.columns and _by_id([(r["doc_id"], r["text"]) for r in got.collect()]) == _by_id(want)


def test_pipeline_with_passages(spark, sf_dir):
    """Every stage's decisions, one after another, in plain Python; then the packing of what is left."""
    assert len(corpus_pipeline.STAGES) == 5
    rows = _pandas(common.documents(spark, sf_dir))
    kept = brute.quality_kept(list(rows["text"]), list(rows["source"]))
    left = {d: t for d, t, k in zip(rows["doc_id"], rows["text"], kept, strict=True) if k}
    component = brute.jaccard_components(left, 5, 80)
    left = {d: t for d, t in left.items() if component[d] == d}
    left = dict(zip(left, _without_passages(list(left.values())), strict=True))
    limits = secret_scan.EntropyLimits()
    for d, t in left.items():
        base = brute.base_spans(t)
        left[d] = brute.redacted(t, [*base, *brute.entropy_spans(t, base, limits, secret_scan.ALLOWED)])
    _check_packing(corpus_pipeline.run(spark, sf_dir).collect(), list(zip(left, _encoded(list(left.values())), strict=True)))
