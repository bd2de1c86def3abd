"""Operator 13: a quality classifier by compression with dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm import common


@dataclass(frozen=True)
class CompressionSettings:
    """docs_per_label and longest bound the labelled sample that the driver learns from: at most that many
    documents of each label, each of at most that many bytes. Scoring has no bound."""

    docs_per_label: int = 2000
    longest: int = 32_768
    dictionary: int = 65_536
    block: int = 512  # bytes that are compressed on their own, so that a long text keeps asking the dictionaries
    level: int = 3
    samples: int = 8000  # blocks that a dictionary is built from
    smoothing: tuple[int, ...] = (0, 25, 50, 100, 200)
    least: float = 0.3


def _blocks(text: str, size: int) -> list[bytes]:
    data = text.encode()
    return [data[i : i + size] for i in range(0, len(data), size)]


def _dictionary(texts: list[str], s: CompressionSettings) -> bytes:
    """Trained by the library on blocks of the texts, evenly spread; of too few, their bytes themselves."""
    import zstandard

    blocks = [b for t in texts for b in _blocks(t, s.block)]
    step = max(1, -(-len(blocks) // s.samples))
    blocks = blocks[::step]
    try:
        return zstandard.train_dictionary(s.dictionary, blocks, level=s.level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-s.dictionary :]


class CompressionModel:
    """Two dictionaries, and a logistic curve from the normalised difference of sizes to a score.

    The difference of a text is (size with the bad dictionary - size with the good one) over its bytes,
    summed over its blocks: positive for text that the good dictionary knows, about zero for text that
    any dictionary shrinks alike, such as one word repeated. `smoothing` bytes of a middling good text are
    added to both parts of the ratio, so that a few bytes don't decide and an empty text has a score.
    """

    def __init__(self, settings: CompressionSettings = CompressionSettings()):
        self.settings, self.dictionaries = settings, None
        self.share, self.middling, self.smooth, self.slope, self.shift = 0.5, 0.0, 0, 0.0, 0.0

    def _compressors(self) -> list:
        import zstandard

        s, out = self.settings, []
        for data in self.dictionaries:
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=s.level)
            c = zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            out.append((c.compress, len(c.compress(b""))))
        return out

    def sizes(self, texts: list[str]) -> np.ndarray:
        """Gain of the good dictionary in bytes, and the text's bytes, for each whole text."""
        (bad, none_bad), (good, none_good) = self._compressors()
        out = np.zeros((len(texts), 2))
        for i, t in enumerate(texts):
            blocks = _blocks(t, self.settings.block)
            out[i] = sum(len(bad(b)) - len(good(b)) for b in blocks) - len(blocks) * (none_bad - none_good), sum(map(len, blocks))
        return out

    def difference(self, sizes: np.ndarray, smooth: int | None = None) -> np.ndarray:
        k = self.smooth if smooth is None else smooth
        whole = sizes[:, 1] + k
        return np.where(whole > 0, (sizes[:, 0] + k * self.middling) / np.maximum(whole, 1), self.middling)

    def fit(self, texts: list[str], labels: list[int], share: float) -> CompressionModel:
        """`share` is that of label 1 among all labelled rows: the sample holds both labels alike, so its
        documents are weighted back. Every fourth of each label is kept from the dictionaries and fits
        the curve, and the smoothing that gives it the least log loss is taken. With one label only,
        every score is `share`."""
        self.share = share
        sides = [[t for t, y in zip(texts, labels, strict=True) if y == k] for k in (0, 1)]
        if not all(sides):
            return self
        fitted = [x if len(x) < 8 else [t for i, t in enumerate(x) if i % 4 != 3] for x in sides]
        kept = [x if len(x) < 8 else x[3::4] for x in sides]
        self.dictionaries = [_dictionary(x, self.settings) for x in fitted]
        y = np.repeat([0.0, 1.0], [len(x) for x in kept])
        w = np.where(y == 1, share / len(kept[1]), (1 - share) / len(kept[0]))
        sizes = self.sizes(kept[0] + kept[1])
        self.middling = float(np.median(self.difference(sizes, 0)[y == 1]))
        best = None
        for k in self.settings.smoothing:
            loss, slope, shift = _curve(self.difference(sizes, k), y, w)
            if best is None or loss < best - 1e-9:
                best, self.smooth, self.slope, self.shift = loss, k, slope, shift
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        if self.dictionaries is None:
            return np.full(len(texts), float(self.share))
        return _logistic(self.slope * self.difference(self.sizes(texts)) + self.shift)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-4) -> tuple[float, float, float]:
    """Weighted logistic regression in one variable by Newton's method: loss, slope (not below 0), shift."""
    mid, unit = float(np.average(x, weights=w)), float(np.sqrt(np.cov(x, aweights=w, bias=True))) or 1.0
    a = np.stack([(x - mid) / unit, np.ones(len(x))], axis=1)
    b = np.zeros(2)
    loss = lambda b: float(-(w * (y * np.log(_logistic(a @ b)) + (1 - y) * np.log(1 - _logistic(a @ b)))).sum() + ridge * b[0] ** 2 / 2)
    for _ in range(100):
        p = _logistic(a @ b)
        down = a.T @ (w * (y - p)) - ridge * np.array([b[0], 0])
        step = np.linalg.solve((a.T * (w * p * (1 - p))) @ a + np.diag([ridge, 1e-9]), down)
        while loss(b + step) > loss(b) and np.abs(step).max() > 1e-10:
            step = step / 2
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    slope = max(0.0, b[0] / unit)
    return loss(b), slope, b[1] - slope * mid


def held_out(id_column: str) -> Column:
    """Ids that training never sees: CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, settings: CompressionSettings = CompressionSettings(), id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> CompressionModel:
    """Fit on a bounded sample: of each label, the documents with the smallest hash of their id.

    Labels other than 0 and 1, null ids and held-out ids are left out, and so is an id that has both labels.
    Of documents with one id, the least text counts, once; null, empty and longer texts than `longest`
    bytes aren't learned from, and of equal texts one is.
    """
    known = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull() & ~held_out(id_column))
    known = known.groupBy(F.col(id_column).alias("d")).agg(F.min(label_column).alias("y"), F.max(label_column).alias("z")).where("y = z")
    known = common.materialise(known.select("d", F.col("y").cast("int").alias("y"), F.xxhash64(F.col("d").cast("string")).alias("h")), "labels")
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # At most 2 * docs_per_label ids, so they are broadcast; a document that many rows repeat is one group's minimum.
    chosen = [known.where(F.col("y") == y).orderBy("h", "d").limit(settings.docs_per_label) for y in (0, 1)]
    texts = docs.select(F.col(id_column).alias("d"), F.col(text_column).alias("text")).where(F.octet_length("text").between(1, settings.longest))
    sample = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "d").groupBy("h", "d", "y").agg(F.min("text").alias("text")).collect()
    common.discard(known)
    pairs = dict.fromkeys((r["text"], r["y"]) for r in sorted(sample, key=lambda r: (r["h"], r["d"])))
    total = sum(n.values())
    return CompressionModel(settings).fit([t for t, _ in pairs], [y for _, y in pairs], n.get(1, 0) / total if total else 0.5)


def classify_quality(docs: DataFrame, model: CompressionModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for each row's whole text; no shuffle.

    The score sees nothing but the text; equal texts have equal scores. A null text counts as empty, and
    an empty one has the score of a middling good text, since nothing speaks against it.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # two dictionaries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["doc_id", "held_out"]].assign(score=shared.value.score(batch["text"].tolist()))

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out(id_column).alias("held_out"), common.empty_text(text_column).alias("text"))
    scored = rows.mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= model.settings.least).cast("int"))
