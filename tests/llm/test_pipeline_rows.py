"""Repeated rows, repeated ids and null ids through the whole chain of the pipeline."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, _encoded


def _prose(seed: int, n: int = 120) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(n))


def test_one_row_of_each_group_reaches_the_end(spark, tmp_path):
    copied, unnamed, both, single = (_prose(k) for k in range(1, 5))
    rows = [
        (5, copied), (5, copied), (5, copied),  # a repeated row
        (None, unnamed), (None, unnamed), (None, unnamed + " end"),  # copies without an id
        (9, both), (None, both), (7, both + " end"),  # the smallest id stays
        (3, single), (3, _prose(6)),  # one id for two texts
        (4, copied + " end"),  # a near copy of the repeated row, of a smaller id
        (3, both + " more"),  # its id is that of other texts, which stay
    ]
    frame = spark.createDataFrame([(i, t, "en", "a", len(t), *[None] * 6) for i, t in rows], SCHEMA)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    near = corpus_pipeline.near_duplicates(spark, frame, str(tmp_path))
    kept = sorted(((r["doc_id"], r["text"]) for r in near.collect()), key=str)
    assert near.columns == frame.columns
    texts = [t for _, t in kept]
    assert sorted((i, t[:20]) for i, t in kept if i is not None) == sorted([(3, single[:20]), (3, _prose(6)[:20]), (4, copied[:20]), (3, both[:20])])
    assert len(kept) == 5 and [t[:20] for i, t in kept if i is None] == [unnamed[:20]]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    length = {len(ids) + 1 for ids in _encoded(texts)}
    assert sorted(map(str, (r["doc_id"] for r in packed))) == sorted(str(i) for i, _ in kept)
    assert {r["length"] for r in packed} <= length | {len(x) + 1 for x in _encoded([unnamed, unnamed + " end"])} and min(r["length"] for r in packed) > 100
