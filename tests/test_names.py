"""Pieces of names against difflib over all pairs."""

import difflib
import random

from quantloom.operators import names as nm


def plain(piece, names, sounds):
    """(rule, matches) by comparing the piece with every name."""
    exact = sorted(n for n in names if n.lower() == piece.lower())
    if exact:
        return "exact", exact
    chinese = sum("㐀" <= ch <= "鿿" for ch in piece)
    held = sorted(n for n in names if piece.lower() in n.lower())
    if chinese >= 2 and held:
        return "contained", held
    heard = sorted(n for n in names if piece.lower() in sounds.get(n, ""))
    if not chinese and len(piece) >= 5 and heard:
        return "sound", heard
    if len(piece) > 2:
        if close := difflib.get_close_matches(piece, names, n=5, cutoff=0.8):
            return "fuzzy", close
        near = difflib.get_close_matches(piece, names, n=5, cutoff=0.7)
        if slips := [n for n in near if len(n) == len(piece) and sum(x != y for x, y in zip(n, piece, strict=True)) == 1]:
            return "slip", slips
    return None, []


def test_against_all_pairs(spark):
    rng = random.Random(7)
    sounds = {"贵州茅台": "guizhoumaotai", "中国平安": "zhongguopingan", "平安银行": "pinganyinhang", "中国中免": "zhongguozhongmian", "阿里巴巴": "alibaba"}
    names = list(sounds) + ["Apple Inc", "APPLE INC", "Microsoft", "Tesla", "abcabc", "aaaa", "x"]
    names += ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 12))) for _ in range(60)]
    pieces = ["贵州茅苔", "茅台", "平安", "maotai", "pingan", "ping", "alibab", "apple inc", "Microsft", "Tesle", "中国", "州", "aaab", "aaa", "bcabca", "nothing like it", "a%b", "\\d+"]
    for name in names[8:]:
        i = rng.randrange(len(name) + 1)
        pieces += [name[:i] + rng.choice("abxy") + name[i:], name[:i] + name[i + 1 :], name[::-1], name[:i] + "q" + name[i + 1 :]]
    rows = [(n, sounds.get(n)) for n in names + names[:3]] + [(None, None), ("", None)]
    table = spark.createDataFrame(rows, "name string, pinyin string")
    got = {r.piece: (r.rule, list(r.matches)) for r in nm.resolve(spark.createDataFrame([(p,) for p in [*pieces, *pieces, None, ""]], "piece string"), table).collect()}
    names = sorted(set(names))
    assert got == {p: plain(p, names, sounds) for p in set(pieces) if p}
    assert {r for r, _ in got.values()} == {"exact", "contained", "sound", "fuzzy", "slip", None}


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "piece string"), spark.createDataFrame([("abc",)], "piece string")
    names = spark.createDataFrame([("abc",)], "name string")
    assert nm.resolve(none, names).count() == 0
    assert [tuple(r) for r in nm.resolve(some, names.limit(0)).collect()] == [("abc", None, [])]
