"""The encoder of the pipeline's packing, whose memory is bounded more tightly."""

from __future__ import annotations

import tracemalloc

import corpus_pipeline
from quantloom.llm import queries, tokens
from quantloom.llm.packing import pack
from tests.llm.test_operators import SCHEMA, _by_id, _encoded, _odd_rows
from tests.llm.test_passages import _words


def _peak(encoder: tokens.ChunkEncoder, texts: list[str]) -> tuple[int, list[bytes]]:
    tracemalloc.start()
    try:
        out = encoder.encode(texts)
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


def test_one_batch_does_not_fill_a_worker(monkeypatch):
    monkeypatch.setattr(tokens, "LEAN_CHUNKS", 2_000)
    monkeypatch.setattr(tokens, "LEAN_CHARS", 50_000)
    texts = [" ".join(_words(k, 1_000)) for k in range(40)]  # one batch, nearly all words distinct
    path = queries.tokenizer(queries.BYTE_BPE)
    most, want = _peak(tokens.ChunkEncoder(path), texts)
    lean = tokens.ChunkEncoder(path, lean=True)
    least, got = _peak(lean, texts)
    assert got == want and least < 0.8 * most
    assert len(lean.kept) + len(lean.older) < 2 * (tokens.LEAN_CHUNKS + tokens.LEAN_CHARS / 5)


def test_what_is_dropped_is_encoded_again(monkeypatch):
    monkeypatch.setattr(tokens, "LEAN_CHUNKS", 50)
    monkeypatch.setattr(tokens, "LEAN_CHARS", 300)
    texts = [" ".join(_words(k % 7, 60)) for k in range(40)] + ["", "a  b", "x\ny z.", "long " * 300]
    encoder = tokens.ChunkEncoder(queries.tokenizer(queries.BYTE_BPE), lean=True)
    assert encoder.encode(texts) == tokens.ChunkEncoder(queries.tokenizer(queries.BYTE_BPE)).encode(texts)
    assert [len(x) // 4 for x in encoder.encode(texts)] == [len(x) for x in _encoded(texts)]
    assert len(encoder.kept) + len(encoder.older) < 500 and encoder.encode([]) == []


def test_the_pipeline_packs_the_same_with_lean_encoders(spark, monkeypatch):
    docs = spark.createDataFrame(_odd_rows(), SCHEMA)
    asked = []
    monkeypatch.setattr(corpus_pipeline, "pack", lambda *a, **b: asked.append(b) or pack(*a, **b))
    got = corpus_pipeline.packing(spark, docs, "")
    want = pack(docs, queries.tokenizer(queries.BYTE_BPE), end_id=2, capacity=1024)
    assert asked[0]["lean"] and got.columns == want.columns
    key = lambda rows: _by_id([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows])
    assert key(got.collect()) == key(want.collect())
