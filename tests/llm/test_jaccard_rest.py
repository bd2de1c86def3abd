"""Pairs of large groups that are compared one by one: no link may be ruled out by its parity bits."""

from __future__ import annotations

import random

from quantloom.llm.jaccard_join import JaccardSettings, _rest, jaccard_groups
from tests.llm import brute

TOP = -(1 << 63)


def test_parity_bits_that_differ_in_the_sign_bit(spark):
    """Two bits apart, one of them the top one: near. Sixty bits apart: not near."""
    bits = {1: [0, 0], 2: [TOP | 1, 0], 3: [(1 << 60) - 1, 0], 4: [0, TOP | 4]}
    rows = spark.createDataFrame([(5, k, 100, 0, k) for k in bits], "key long, node long, n int, place int, component long")
    table = spark.createDataFrame(list(bits.items()), "node long, bits array<long>")
    for settings in (JaccardSettings(), JaccardSettings(block=2)):
        found = {tuple(sorted(r)) for r in _rest(rows, table, settings).collect()}
        assert found == {(1, 2), (1, 4), (2, 4)}


def test_groups_without_pivots_against_brute_force(spark):
    """Families of near copies that differ in a few words, all settled pair by pair."""
    r, texts = random.Random(8), {}
    vocabulary = [f"w{k}" for k in range(5000)]
    for family in range(40):
        base = r.choices(vocabulary, k=300)
        for copy in range(4):
            words = list(base)
            for _ in range(copy and 2):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            texts[family * 10 + copy] = " ".join(words)
    settings = JaccardSettings(words_of_bits=1, few=2, pivots=0)
    rows = jaccard_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), settings).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute.jaccard_components(texts, settings.words, settings.percent)
