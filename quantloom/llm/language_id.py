"""Operator 7: language of whole texts by averaged hashed subword embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm import common

UNDETERMINED = "und"
#: ASCII that isn't a letter becomes a space; other bytes stay.
TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass(frozen=True)
class LanguageSettings:
    """docs_per_language and languages bound the sample that the driver trains on."""

    docs_per_language: int = 1200
    languages: int = 200
    bits: int = 18
    dims: int = 16
    sizes: tuple[int, ...] = (1, 2, 3, 4)
    epochs: int = 4
    rate: float = 0.5
    accepted_accuracy: float = 0.99


def subwords(texts: list[str], settings: LanguageSettings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of some texts, and each one's text.

    A subword is a run of `sizes` UTF-8 bytes of the lower-cased text, where runs of anything but
    letters are single spaces; it may begin or end with the space, not hold it inside.
    """
    coded = [b" " + b" ".join(t.lower().encode().translate(TO_SPACE).split()) + b" " for t in texts]
    owner = np.repeat(np.arange(len(coded), dtype=np.int32), [len(x) for x in coded])
    data = np.frombuffer(b"".join(coded), np.uint8)
    blank, value = data == 32, data.astype(np.uint32) + np.uint32(1)
    buckets, owners = [], []
    for n in settings.sizes:
        if len(data) < n:
            break
        last = len(data) - n + 1
        h = np.full(last, 2166136261 + 97 * n, np.uint32)
        for k in range(n):
            h = (h ^ value[k : k + last]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        ok = owner[:last] == owner[n - 1 :]
        for k in range(1, n - 1):
            ok &= ~blank[k : k + last]
        ok &= ~(blank[:last] & blank[n - 1 :])
        buckets.append((h[ok] & np.uint32((1 << settings.bits) - 1)).astype(np.int32))
        owners.append(owner[:last][ok])
    return np.concatenate(buckets or [np.zeros(0, np.int32)]), np.concatenate(owners or [np.zeros(0, np.int32)])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class LanguageModel:
    """A text's mean embedding, through a linear softmax. Prediction uses the product of both: each
    bucket's share of every language's score."""

    def __init__(self, languages: list[str], settings: LanguageSettings):
        self.languages, self.settings = languages, settings
        self.scores = np.zeros((1 << settings.bits, len(languages)), np.float32)
        self.temperature, self.least = 1.0, 0.0

    def fit(self, texts: list[str], labels: list[str]) -> LanguageModel:
        """Stochastic gradient descent over all texts but every fourth; on those, the temperature that
        gives the least log loss, and the least score at which accepted texts are accurate enough."""
        s, rng = self.settings, np.random.default_rng(7)
        at = {x: i for i, x in enumerate(self.languages)}
        y = np.array([at[x] for x in labels])
        known = []
        for t in texts:
            buckets, n = np.unique(subwords([t], s)[0], return_counts=True)
            known.append((buckets, (n / max(1, n.sum())).astype(np.float32)))
        train = [i for i in range(len(texts)) if i % 4 != 3 or len(texts) < 8]
        held = [i for i in range(len(texts)) if i % 4 == 3 and len(texts) >= 8]
        table = rng.uniform(-1 / s.dims, 1 / s.dims, (1 << s.bits, s.dims)).astype(np.float32)
        weights = np.zeros((s.dims, len(self.languages)), np.float32)
        steps, step = s.epochs * len(train), 0
        for _ in range(s.epochs):
            for i in rng.permutation(train):
                buckets, share = known[i]
                rate = s.rate * (1 - step / steps)
                step += 1
                if not len(buckets):
                    continue
                mean = share @ table[buckets]
                error = _softmax(mean @ weights)
                error[y[i]] -= 1
                back = weights @ error
                weights -= rate * np.outer(mean, error)
                # Of equal size for every bucket, as in a sum over subwords: shares would vanish.
                table[buckets] -= rate * back
        self.scores = table @ weights
        if held:
            logits = np.array([share @ self.scores[buckets] if len(buckets) else np.zeros(len(self.languages)) for buckets, share in (known[i] for i in held)])
            right = y[held]
            loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(held)), right] + 1e-12).mean()
            self.temperature = float(min(np.geomspace(0.5, 20, 60), key=loss))
            p = _softmax(logits / self.temperature)
            best, hit = p.max(axis=1), p.argmax(axis=1) == right
            order = np.argsort(-best, kind="stable")
            accurate = np.cumsum(hit[order]) / np.arange(1, len(order) + 1) >= s.accepted_accuracy
            self.least = float(best[order][np.flatnonzero(accurate)[-1]]) if accurate.any() else 1.0
            self.least = min(self.least, 0.5) if accurate.all() else self.least
        return self

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the score is too low to rely on, for each text."""
        spoken = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
        names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if spoken and self.languages:
            buckets, owners = subwords([texts[i] for i in spoken], self.settings)
            n = np.maximum(1, np.bincount(owners, minlength=len(spoken)))
            # The product keeps few columns: one weighted count for each language.
            logits = np.stack([np.bincount(owners, self.scores[:, k][buckets], len(spoken)) for k in range(len(self.languages))], axis=1) / n[:, None]
            p = _softmax(logits / self.temperature)
            for i, k, x in zip(spoken, p.argmax(axis=1), p.max(axis=1), strict=True):
                names[i], score[i] = self.languages[k], x
        return names, score, score < self.least


def held_out(id_column: str) -> Column:
    """Ids that training never sees: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, settings: LanguageSettings = LanguageSettings(), id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> LanguageModel:
    """Fit on a bounded sample: for each language, the rows with the smallest hash of their id, of those
    with text and label that aren't held out. The rarest languages beyond `languages` are left out."""
    rows = docs.where(F.col(text_column).isNotNull() & F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column))
    ids = rows.select(F.col(id_column).alias("d"), F.col(label_column).alias("l"), F.xxhash64(F.col(id_column).cast("string")).alias("h"))
    names = [r["l"] for r in ids.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(settings.languages).collect()]
    first = F.row_number().over(Window.partitionBy("l").orderBy("h", "d"))
    chosen = ids.where(F.col("l").isin(names)).withColumn("k", first).where(F.col("k") <= settings.docs_per_language).select("d", "l", "h")
    # At most languages x docs_per_language ids, so they may be broadcast.
    texts = rows.join(F.broadcast(chosen.select("d").distinct()), F.col(id_column) == F.col("d"), "left_semi")
    sample = texts.select(text_column, label_column, F.xxhash64(F.col(id_column).cast("string"))).collect()
    sample = sorted((h, label, text) for text, label, h in sample if label in names)
    return LanguageModel(sorted(names), settings).fit([x[2] for x in sample], [x[1] for x in sample])


def identify(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for each row's whole text; no shuffle.

    `und` with score 0 for texts that are null or have no letter; `rejected` says that the calibrated
    score is below that at which held-out texts of the sample were accurate enough.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # buckets x languages numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [None if t is None or t != t else t for t in batch["text"]]
            parts = [shared.value.predict(texts[i : i + 100]) for i in range(0, len(texts), 100)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": [x for p in parts for x in p[0]], "score": np.concatenate([p[1] for p in parts]) if parts else [], "rejected": np.concatenate([p[2] for p in parts]) if parts else []})

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out(id_column).alias("held_out"), F.col(text_column).alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
