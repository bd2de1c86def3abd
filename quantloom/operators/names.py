"""Pieces of names resolved to whole names: equal, contained, by their sound, or alike but for a slip.

No step compares all pairs. Contained pieces meet names on the piece's rarest pair of letters. Names that are
alike meet on letters too: two texts whose matching blocks hold m letters have at least m letters in common,
repeats counted, so they share one among each one's rarest few, and only such pairs are compared.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

c = F.col
#: Ratios of alike names and of slips, names a piece may get, the shortest pieces by rule.
ALIKE, SLIP, MOST = 0.8, 0.7, 5
FUZZY_FROM, SOUND_FROM, CHINESE_FROM = 3, 5, 2
_CHINESE = r"[\x{3400}-\x{9fff}]"


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def _pairs(text: Column) -> Column:
    """The distinct pairs of neighbouring letters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))


def containing(pieces: DataFrame, names: DataFrame, piece: str, within: str) -> DataFrame:
    """All rows of pieces with all rows of names whose text `within` holds `piece`, of two letters or more.

    A piece goes out on one pair of letters, the one that the fewest names have; without a name that has
    it, the piece is in none.
    """
    index = names.withColumn("_pair", F.explode(_pairs(c(within))))
    held = index.groupBy("_pair").agg(F.count(F.lit(1)).alias("_n"))
    asked = pieces.where(F.char_length(piece) >= 2).withColumn("_pair", F.explode(_pairs(c(piece)))).join(held, "_pair", "left")
    rarest = asked.groupBy(*pieces.columns).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_pair")).alias("_rarest"))
    rarest = rarest.where("_rarest.n > 0").select(*pieces.columns, c("_rarest._pair").alias("_pair"))
    return rarest.join(index, "_pair").where(c(within).contains(c(piece))).drop("_pair")


def _numbered_letters(df: DataFrame, text: str) -> DataFrame:
    """Each letter with its number among its likes: in common, repeats count as often as both have them."""
    letters = _letters(c(text))
    numbered = F.transform(letters, lambda x, i: F.concat(x, F.size(F.filter(F.slice(letters, 1, i + 1), lambda y: y == x)).cast("string")))
    return df.select(text, F.explode(numbered).alias("_letter"))


def _rarest(df: DataFrame, text: str, ranks: DataFrame, ratio: float) -> DataFrame:
    """text, _length, _letter: the rarest letters of a text, as many as it takes to meet any text alike."""
    lettered = _numbered_letters(df, text).join(ranks, "_letter", "left")
    listed = lettered.groupBy(text).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), c("_letter").alias("letter")))).alias("_all"))
    length = F.size("_all")
    # Texts alike are at least this long, and hold at least this many letters in common with this one.
    shortest = F.ceil(length * ratio / (2 - ratio) - 1e-9)
    common = F.ceil((length + shortest) * ratio / 2 - 1e-9)
    return listed.select(text, length.alias("_length"), F.explode(F.slice("_all", F.lit(1), (length - common + 1).cast("int"))).alias("_one")).select(text, "_length", c("_one.letter").alias("_letter"))


@F.pandas_udf(DoubleType())
def ratio_of(piece: pd.Series, name: pd.Series) -> pd.Series:
    """difflib's ratio, with the name first; the batch's pieces come sorted or not."""
    matcher, out, last = difflib.SequenceMatcher(), [], None
    for p, n in zip(piece, name, strict=True):
        if p != last:
            matcher.set_seq2(p)
            last = p
        matcher.set_seq1(n)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def alike(pieces: DataFrame, names: DataFrame, ratio: float) -> DataFrame:
    """piece, name, ratio: all pairs of difflib's ratio or more. Both are distinct and not empty."""
    ranks = _numbered_letters(names, "name").groupBy("_letter").agg(F.count(F.lit(1)).alias("_n"))
    left, right = _rarest(pieces.select("piece"), "piece", ranks, ratio), _rarest(names.select("name"), "name", ranks, ratio)
    right = right.withColumnRenamed("_length", "_other")
    fits = 2 * F.least("_length", "_other") >= ratio * (c("_length") + c("_other")) - 1e-9
    pairs = left.join(right, "_letter").where(fits).select("piece", "name").distinct()
    return pairs.withColumn("ratio", ratio_of("piece", "name")).where(c("ratio") >= ratio)


def resolve(pieces: DataFrame, names: DataFrame) -> DataFrame:
    """piece, rule, matches: each distinct piece with the names of the first rule that finds any.

    exact: equal but for case. contained: a piece with two Chinese characters or more is within the name.
    sound: a piece of five letters or more without Chinese characters is within the name's `pinyin` (only
    if the names have such a column). fuzzy: the five names most alike, of ratio 0.8 or more; slip: of the
    five most alike of ratio 0.7 or more, those as long and with one letter different; both for pieces of three
    letters or more. Matches of the first three rules are in order of name, of the last two by ratio, larger
    names first among equals. Pieces and names that are null or empty are none; unresolved pieces have no rule.
    """
    asked = pieces.select("piece").where("piece <> ''").distinct()
    known = names.where("name <> ''").dropDuplicates(["name"])
    lower = asked.withColumn("_low", F.lower("piece"))
    named = known.select("name", F.lower("name").alias("_name"))
    chinese = F.regexp_count("piece", F.lit(_CHINESE))
    found = [lower.join(named, lower["_low"] == named["_name"]).select("piece", "name", F.lit(1).alias("rank"), F.lit(1.0).alias("ratio"))]
    found.append(containing(lower.where(chinese >= CHINESE_FROM), named, "_low", "_name").select("piece", "name", F.lit(2).alias("rank"), F.lit(1.0).alias("ratio")))
    if "pinyin" in known.columns:
        sounds = known.where("pinyin IS NOT NULL").select("name", F.lower("pinyin").alias("_name"))
        long = lower.where((chinese == 0) & (F.char_length("_low") >= SOUND_FROM))
        found.append(containing(long, sounds, "_low", "_name").select("piece", "name", F.lit(3).alias("rank"), F.lit(1.0).alias("ratio")))
    near = alike(asked.where(F.char_length("piece") >= FUZZY_FROM), known, SLIP)
    place = F.row_number().over(Window.partitionBy("piece").orderBy(F.desc("ratio"), F.desc("name")))
    near = near.withColumn("_place", place).where(c("_place") <= MOST)  # Spark keeps five a task before it shuffles
    found.append(near.select("piece", "name", F.lit(4).alias("rank"), "ratio"))
    everything = found[0]
    for more in found[1:]:
        everything = everything.unionByName(more)

    best = everything.groupBy("piece", "rank").agg(F.collect_list(F.struct("ratio", "name")).alias("all"))
    first = best.groupBy("piece").agg(F.min_by(F.struct("rank", "all"), "rank").alias("b")).select("piece", "b.*")
    five = F.reverse(F.array_sort("all"))
    good = F.filter(five, lambda x: x["ratio"] >= ALIKE)
    one_off = lambda n: (F.char_length(n) == F.char_length("piece")) & (F.size(F.filter(F.arrays_zip(_letters(n).alias("x"), _letters(c("piece")).alias("y")), lambda z: z["x"] != z["y"])) == 1)
    slips = F.filter(five, lambda x: one_off(x["name"]))
    in_order = F.array_sort(F.transform("all", lambda x: x["name"]))
    listed = lambda a: F.transform(a, lambda x: x["name"])
    matches = F.when(c("rank") < 4, in_order).when(F.size(good) > 0, listed(good)).otherwise(listed(slips))
    rule = F.when(c("rank") < 4, F.element_at(F.array(F.lit("exact"), F.lit("contained"), F.lit("sound")), F.least("rank", F.lit(3)))).when(F.size(good) > 0, "fuzzy").when(F.size(slips) > 0, "slip")
    resolved = first.select("piece", rule.alias("rule"), matches.alias("matches"))
    return asked.join(resolved, "piece", "left").select("piece", "rule", F.coalesce("matches", F.array().cast("array<string>")).alias("matches"))
