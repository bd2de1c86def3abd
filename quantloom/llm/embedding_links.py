"""Operator 3: near-duplicate vectors by spherical-cap filters."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import common
from quantloom.llm.components import components


@dataclass(frozen=True)
class CapSettings:
    cosine: float = 0.95
    filters: int = 24  # filters that a random vector exceeds, on average
    least: int = 12  # filters that any vector gets: its best ones if too few exceed
    bucket: int = 40  # random vectors in a filter, on average
    blocks: int = 3  # factors of the product code
    block: int = 4000  # vectors of a filter that one task compares with one another
    seed: int = 11


class ProductCode:
    """Directions (c1, ..., cm) of a random product code: the space is turned at random and cut into m
    parts, each with its own random unit vectors; a direction takes one of each part. A vector's
    score for a direction is the sum of its parts' inner products, over sqrt(m)."""

    def __init__(self, dims: int, n_vectors: int, s: CapSettings):
        self.m = m = min(s.blocks, dims)
        wanted = max(2 * s.filters, s.filters * n_vectors / s.bucket)
        self.size = max(2, min(256, math.ceil(wanted ** (1 / m))))
        rng = np.random.default_rng(s.seed)
        turn, _ = np.linalg.qr(rng.normal(size=(dims, dims)))
        self.cuts = np.array_split(np.arange(dims), m)
        self.codes = []
        for part in self.cuts:
            c = rng.normal(size=(self.size, len(part)))
            c /= np.linalg.norm(c, axis=1, keepdims=True)
            self.codes.append((turn[:, part] @ c.T).astype(np.float32))
        share = min(0.5, s.filters / self.size**m)
        self.cap = float(NormalDist().inv_cdf(1 - share) * math.sqrt(m / dims))
        self.least = min(s.least, self.size**m)

    def decode(self, units: np.ndarray) -> list[np.ndarray]:
        """For each unit vector, all directions whose cap it lies in, or its `least` best if they are
        more. Lists grow part by part; what can't reach the cap with the best of the parts to come
        is dropped."""
        scores = [units.astype(np.float32) @ c for c in self.codes]
        rest = np.zeros(len(units), np.float32)
        later = []
        for x in scores[:0:-1]:
            rest = rest + x.max(axis=1)
            later.append(rest)
        later = later[::-1] + [np.zeros(len(units), np.float32)]
        cap = np.full(len(units), self.cap, np.float32)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(units)
        left = np.arange(len(units))
        while len(left):
            row, code, score = np.arange(len(left)), np.zeros(len(left), np.int64), np.zeros(len(left), np.float32)
            for x, ahead in zip(scores, later, strict=True):
                sums = score[:, None] + x[left[row]]
                keep = sums + ahead[left[row], None] >= cap[left[row], None]
                at, k = np.nonzero(keep)
                row, code, score = row[at], code[at] * self.size + k, sums[at, k]
            n = np.bincount(row, minlength=len(left))
            ends = np.cumsum(n)
            for i in np.flatnonzero(n >= self.least):
                out[left[i]] = code[ends[i] - n[i] : ends[i]]
            left = left[n < self.least]
            cap[left] -= 0.04 * math.sqrt(self.m)
        return out


@functools.lru_cache(maxsize=8)
def product_code(dims: int, n_vectors: int, s: CapSettings) -> ProductCode:
    """The same for every task: it follows from its parameters. Vectors of each length have their own."""
    return ProductCode(dims, n_vectors, s)


def _units(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # very large or small components can't over- or underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _spread(classes: DataFrame, n_vectors: int, s: CapSettings) -> DataFrame:
    """dims, filter, rep: every class under all filters whose cap it lies in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, some in batch.groupby(batch["vector"].map(len)):
                found = product_code(dims, n_vectors, s).decode(_units(list(some["vector"])))
                n = [len(x) for x in found]
                yield pd.DataFrame({"dims": dims, "filter": np.concatenate(found), "rep": np.repeat(some["rep"].to_numpy(np.int64), n)})

    return classes.select("rep", "vector").mapInPandas(run, "dims int, filter long, rep long")


def _rounded(classes: DataFrame) -> DataFrame:
    """rep, code, step, error: each unit vector as bytes times a step, and the length of what that leaves out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rep, vector in zip(batch["rep"].tolist(), batch["vector"], strict=True):
                x = _units([vector])[0]
                step = np.abs(x).max() / 127
                code = np.round(x / step).astype(np.int8)
                rows.append((rep, code.tobytes(), step, float(np.linalg.norm(x - code * step))))
            yield pd.DataFrame(rows, columns=["rep", "code", "step", "error"])

    return classes.select("rep", "vector").mapInPandas(run, "rep long, code binary, step double, error double")


def _candidates(spread: DataFrame, rounded: DataFrame, s: CapSettings) -> DataFrame:
    """a, b (a < b): classes of one filter whose rounded vectors don't rule the threshold out. The bound on
    the rounding error is each pair's own, so no linked pair of a filter is lost."""
    sizes = spread.groupBy("dims", "filter").agg(F.count("*").alias("members")).where("members > 1")
    rows = spread.join(sizes, ["dims", "filter"]).withColumn("blocks", F.ceil(F.col("members") / s.block).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    one = rows.where("blocks = 1").withColumn("other", F.col("block"))
    many = rows.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = ["dims", "filter", "low", "high"]
    rows = one.union(many).select("dims", "filter", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep")
    rows = rows.join(rounded, "rep").repartition(common.partitions(spread.sparkSession), *group).sortWithinPartitions(*group, "rep")

    def pairs(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(g) < 2:
            return
        x = np.frombuffer(b"".join(g["code"]), np.int8).reshape(len(g), -1) * g["step"].to_numpy()[:, None]
        rep, block, error = g["rep"].to_numpy(np.int64), g["block"].to_numpy(), g["error"].to_numpy()
        split = g["low"].iloc[0] != g["high"].iloc[0]
        for a in range(0, len(g), 1000):
            part = slice(a, a + 1000)
            slack = error[part, None] * (1 + error[None, :]) + error[None, :] + 1e-9
            match = x[part] @ x.T >= s.cosine - slack
            match &= np.arange(len(g))[part, None] < np.arange(len(g))[None, :]
            if split:
                match &= block[part, None] != block[None, :]
            i, j = np.nonzero(match)
            i = i + a
            yield pd.DataFrame({"a": np.minimum(rep[i], rep[j]), "b": np.maximum(rep[i], rep[j])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (held[group] == held[group].iloc[-1]).all(axis=1)
            found = [x for _, g in held[~last].groupby(group, sort=False) for x in pairs(g)]
            held = held[last]
            if found:
                yield pd.concat(found)
        if held is not None:
            yield from pairs(held)

    return rows.mapInPandas(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, classes: DataFrame, s: CapSettings) -> DataFrame:
    """The pairs whose cosine, in double precision, reaches the threshold."""
    both = pairs.join(classes.select(F.col("rep").alias("a"), F.col("vector").alias("x")), "a").join(classes.select(F.col("rep").alias("b"), F.col("vector").alias("y")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, some in batch.groupby(batch["x"].map(len)):
                exact = np.einsum("ij,ij->i", _units(list(some["x"])), _units(list(some["y"]))) >= s.cosine
                yield some.loc[exact, ["a", "b"]]

    return both.select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def embedding_links(vectors: DataFrame, settings: CapSettings = CapSettings(), id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with cosine >= the threshold), component_id
    (smallest id reachable by links, itself included), kept (vec_id = component_id).

    Equal vectors are one class with a multiplicity, so copies cost nothing. Each class goes to all
    filters whose cap it lies in; the number of filters grows with the vectors, so a filter holds
    as many of them at any size. Within a filter, vectors rounded to bytes leave the pairs that may
    reach the threshold; these are compared in double precision. Found links are
    true ones, and a pair is missed only if no filter has both (recall is measured in the tests).
    A filter with more than a block of vectors is compared block by block, each in its own task.

    Null and zero vectors and those with null or non-finite components have no links and stay alone;
    vectors of different lengths never link. Rows that repeat an id count as vectors of their own
    and share its component; rows with a null id come back with a null component and count for
    nobody. An empty table gives an empty result. Other columns are ignored.
    """
    s, spark = settings, vectors.sparkSession
    common.small_batches(spark)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector"))
    sound = F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    good = rows.where(sound)
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    digest = F.sha2(F.concat_ws(",", F.transform("vector", lambda x: (x + F.lit(0.0)).cast("string"))), 256)  # -0.0 is 0.0
    good = good.withColumn("digest", F.unhex(digest))
    classes = good.groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.struct("vec_id", "vector")).alias("x"))
    classes = common.materialise(classes.select("digest", "copies", F.col("x.vec_id").alias("vec_id"), "x.vector"), "vector-classes")
    # Two vectors may share an id: a class is told by a hash of its digest, not by an id.
    classes = classes.withColumn("rep", F.xxhash64("digest"))
    spread = common.materialise(_spread(classes, classes.count(), s), "vector-filters")
    pairs = common.materialise(_candidates(spread, _rounded(classes), s), "vector-pairs")
    links = common.materialise(_verified(pairs, classes, s), "vector-links")
    both = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(links.select("b", "a"))
    degree = both.join(classes.select(F.col("rep").alias("other"), "copies"), "other").groupBy("rep").agg(F.sum("copies").alias("linked"))
    # Rows that repeat an id tie their classes together.
    members = good.select("vec_id", "digest").join(classes.select("digest", "rep", "copies"), "digest").select("vec_id", "rep", "copies")
    members = common.materialise(members, "vector-members")
    ties = members.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    ties = members.join(ties.select("vec_id", "a"), "vec_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    joined = components(links.union(ties), "a", "b").withColumnRenamed("node", "rep")
    named = members.join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep")).join(degree, "rep", "left")
    lowest = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    found = named.join(lowest, "component").select("vec_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    rest = alone.join(members.select("vec_id").distinct(), "vec_id", "left_anti")
    unsound = rows.where(~F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull()).select("vec_id").join(members.select("vec_id").distinct(), "vec_id")
    lost = unsound.join(found.groupBy("vec_id").agg(F.first("component_id").alias("component_id")), "vec_id").select("vec_id", F.lit(0).cast("long").alias("n_links"), "component_id")
    return found.union(lost).withColumn("kept", F.col("vec_id") == F.col("component_id")).union(rest)
