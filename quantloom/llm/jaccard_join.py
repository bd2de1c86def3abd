"""Operator 8: Jaccard self-join on word shingles with token-combination prefixes.

Tokens are shingle hashes in one global order: rare ones first, then frequent and very frequent ones,
each class by hash. Let a set have n tokens and share at least `least` of them with any linked set. The
i-th of the tokens that two linked sets share, in that order, is then one of the first
n - least + i tokens of both: the prefix, extended by i - 1. So each linked pair meets under its first shared
token if that one is rare, under its first two if the first is frequent, and under its first three if
that one is very frequent; these combinations are the index keys.

The members of a key with few are all compared. Those of others are compared with one pivot at a time,
the member nearest to the common part of the group, and members of one component aren't compared any
more: a group of copies costs one comparison for each member. What is still open after a few pivots is
compared pair by pair. Parity bits, as many as a long set has tokens, rule pairs out before texts are
fetched; comparisons are made on the words themselves.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm import common
from quantloom.llm.components import components
from quantloom.llm.shingles import FOLD, mix, shingle_sets


@dataclass(frozen=True)
class JaccardSettings:
    words: int = 3
    percent: int = 90  # two sets link when 100 * intersection >= percent * union
    frequent_share: float = 0.0002  # of the documents, for a token to count as frequent
    very_share: float = 0.002  # for a very frequent one
    least_frequent: int = 8  # sets that hold it, whatever the share
    least_very: int = 64
    frequent_tokens: int = 100_000  # most of them that are told; the choice only affects speed
    triples: int = 5  # longest prefix whose very frequent tokens are indexed in threes
    pairs: int = 12  # longest prefix whose frequent tokens are indexed in twos; beyond, all are keys alone
    words_of_bits: int = 16  # of 64 bits, in which each token of a set flips one
    most_words: int = 512  # for a set of more tokens than bits: as many bits as it has tokens, up to this
    few: int = 32  # members of a key that are all compared at once
    pivots: int = 2  # of a key with more, before what is left is compared pair by pair
    block: int = 20_000  # members of a key that one task pairs with one another
    chunk: int = 128  # texts that one task compares with the same other text

    def least(self, n: int) -> int:
        """Tokens that a set of n shares with a linked one, at least."""
        return -(-self.percent * n // 100)

    def level(self, n: int) -> int:
        """Tokens of a combination of very frequent ones, for sets of n tokens."""
        take = n - self.least(n) + 1
        return max(1, min(3 if take <= self.triples else 2 if take <= self.pairs else 1, self.least(n)))

    def levels(self, n: int) -> tuple[int, ...]:
        """Those under which a set of n tokens can meet a linked one: a pair uses the lower of its two."""
        if self.level(n) == 1 and n - self.least(n) + 1 > self.pairs:
            return (1,)
        return tuple(sorted({min(self.level(n), self.level(m)) for m in range(max(1, self.least(n)), 100 * n // self.percent + 1)}))


def parity_bits(values: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """For each set, bits of which every token flips one. Two sets' bits differ in no more places than
    there are tokens in one of them alone, so far bits rule a link out and near ones prove nothing."""
    bits = np.zeros((len(starts) - 1, words * 64), np.uint8)
    own = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    flat = np.bincount(own * (words * 64) + (values & np.uint64(words * 64 - 1)).astype(np.int64), minlength=bits.size)
    return np.packbits((flat & 1).astype(np.uint8).reshape(bits.shape), axis=1).view(np.int64)


def long_bits(values: np.ndarray, starts: np.ndarray, s: JaccardSettings) -> list:
    """For each set of more tokens than words_of_bits has bits, parity bits in keeping with its length,
    since in a few bits all long sets look alike; None for others."""
    out: list = [None] * (len(starts) - 1)
    for i in np.flatnonzero(np.diff(starts) > 64 * s.words_of_bits):
        own = values[starts[i] : starts[i + 1]]
        size = 64 * min(s.most_words, 1 << int(len(own) - 1).bit_length() - 6)
        flips = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
        out[i] = np.packbits(flips.astype(np.uint8)).view(np.int64)
    return out


def _summaries(docs: DataFrame, s: JaccardSettings) -> DataFrame:
    """kind 0: node, doc_id, set size, digest of the set, its parity bits, those of a long set. kind 1: token, how many sets of a
    task hold it, for the tokens that a fair share of the task's documents hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        tokens, counts, n_docs = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            values, starts = shingle_sets(batch["text"].tolist(), s.words)
            digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(values[a:b].tobytes()), "<i8") for a, b in zip(starts[:-1], starts[1:], strict=True)]).reshape(-1, 2)
            yield pd.DataFrame({"kind": 0, "node": batch["node"], "doc_id": batch["id"].astype("Int64").where(batch["known"]), "n": np.diff(starts), "d0": digests[:, 0], "d1": digests[:, 1], "bits": list(parity_bits(values, starts, s.words_of_bits)), "wide": long_bits(values, starts, s)})
            n_docs += len(batch)
            # Running counts of this task; when they grow large the rarest go, as in a frequency sketch.
            all_tokens, place = np.unique(np.concatenate([tokens, values]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, np.ones(len(values), np.int64)])).astype(np.int64)
            tokens = all_tokens
            if len(tokens) > 1_000_000:
                tokens, counts = tokens[counts > 1], counts[counts > 1]
        top = counts >= max(min(3, s.least_frequent), s.frequent_share * n_docs)
        order = np.argsort(-counts[top], kind="stable")[: s.frequent_tokens]
        yield pd.DataFrame({"kind": 1, "node": tokens[top][order].astype(np.int64), "doc_id": pd.array([None] * len(order), "Int64"), "n": counts[top][order], "d0": 0, "d1": 0, "bits": None, "wide": None})

    ids = docs.select("node", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNotNull().alias("known"), "text")
    return ids.mapInPandas(run, "kind int, node long, doc_id long, n long, d0 long, d1 long, bits array<long>, wide array<long>")


def _frequent(summaries: DataFrame, n_docs: int, s: JaccardSettings) -> tuple[np.ndarray, np.ndarray]:
    """At most `frequent_tokens` tokens, ascending, and which of them are very frequent. Any choice gives
    the same links."""
    rows = summaries.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= max(s.least_frequent, s.frequent_share * n_docs))
    found = rows.orderBy(F.desc("n"), "node").limit(s.frequent_tokens).select("node", "n").collect()
    tokens = np.array([r[0] for r in found], np.int64).astype(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([r[1] for r in found], np.int64)[order] >= max(s.least_very, s.very_share * n_docs)


@functools.lru_cache(maxsize=64)
def _triples(n: int) -> np.ndarray:
    return np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)


def combined_keys(values: np.ndarray, kind: np.ndarray, s: JaccardSettings) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of one set in the global order, whose prefix holds frequent tokens (kind 1, or 2 if very
    frequent), and for each the number of tokens before its last one that are not in the key."""
    n, least = len(values), s.least(len(values))
    take = n - least + 1
    rare = np.flatnonzero(kind[:take] == 0)
    keys, places = [values[rare]], [rare]
    first = len(rare)  # the tokens from here on are frequent
    for level in s.levels(n):
        if level == 1:
            at = np.arange(first, take)
            keys.append(mix(values[at] + np.uint64(1)))
            places.append(at)
            continue
        i, j = np.triu_indices(min(n, take + 1) - first, 1)
        i, j = i + first, j + first
        ok = (i < take) & ((kind[i] == 1) | (level == 2))
        i, j = i[ok], j[ok]
        keys.append(mix(values[i] * np.uint64(3) + mix(values[j])))
        places.append(j - 1)
        if level == 3:
            very = max(first, int(np.searchsorted(kind, 2)))
            i, j, k = _triples(max(0, min(n, take + 2) - very)).T + very
            ok = (i < take) & (j < take + 1)
            i, j, k = i[ok], j[ok], k[ok]
            keys.append(mix(values[i] * np.uint64(5) + mix(values[j] * np.uint64(3) + mix(values[k]))))
            places.append(k - 2)
    keys, places = np.concatenate(keys), np.concatenate(places)
    keys, at = np.unique(keys, return_index=True)
    return keys, places[at]


def index_rows(values: np.ndarray, starts: np.ndarray, frequent: np.ndarray, very: np.ndarray, s: JaccardSettings) -> tuple[np.ndarray, ...]:
    """set number, key, place (see combined_keys) and number of rare tokens in the prefix, for some sets."""
    n = np.diff(starts)
    own = np.repeat(np.arange(len(n)), n)
    take = n - -(-s.percent * n // 100) + 1
    kind = np.zeros(len(values), np.int8)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        hit = frequent[at] == values
        kind[hit] = 1 + very[at[hit]]
    rare = kind == 0
    count = np.concatenate([[0], np.cumsum(rare)])
    nth = count[:-1] - count[starts[:-1]][own]  # rare tokens before it in its set
    rares = count[starts[1:]] - count[starts[:-1]]
    easy = rares >= take  # nearly all: the prefix is all rare
    pick = np.flatnonzero(rare & easy[own] & (nth < take[own]))
    sets, keys, places = [own[pick]], [values[pick]], [nth[pick]]
    for i in np.flatnonzero(~easy & (n > 0)):
        v, c = values[starts[i] : starts[i + 1]], kind[starts[i] : starts[i + 1]]
        order = np.argsort(c, kind="stable")
        k, p = combined_keys(v[order], c[order], s)
        sets.append(np.full(len(k), i))
        keys.append(k)
        places.append(p)
    sets = np.concatenate(sets)
    return sets, np.concatenate(keys), np.concatenate(places), np.minimum(rares, take)[sets]


def _index(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], s: JaccardSettings) -> DataFrame:
    """key, d (digest of the set), node, n, place, rares: the whole index. A task indexes equal sets once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most frequent_tokens numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        seen: set[int] = set()
        for batch in batches:
            values, starts = shingle_sets(batch["text"].tolist(), s.words)
            digests = [xxhash.xxh3_64_intdigest(values[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            seen = seen if len(seen) < 100_000 else set()
            new = np.zeros(len(batch), bool)
            for i, d in enumerate(digests):
                if d not in seen:
                    seen.add(d)
                    new[i] = True
            sets, keys, places, rares = index_rows(values, starts, *shared.value, s)
            keep = new[sets]
            sets = sets[keep]
            d, node = np.array(digests, np.uint64).astype(np.int64), batch["node"].to_numpy(np.int64)
            yield pd.DataFrame({"key": keys[keep].astype(np.int64), "d": d[sets], "node": node[sets], "n": np.diff(starts)[sets].astype(np.int32), "place": places[keep].astype(np.int32), "rares": rares[keep].astype(np.int32)})

    return docs.select("node", "text").mapInPandas(run, "key long, d long, node long, n int, place int, rares int")


def _shared_keys(index: DataFrame, s: JaccardSettings) -> DataFrame:
    """key, node, n, place, rares, members, near. The index is shuffled once and never written: windows
    over its keys tell which keys have two sets or more, and for those of few members which of the
    members after a set can link with it (near). Rows stay that have such, or whose key has many; `same`
    is equal for keys of equal members."""
    key = Window.partitionBy("key")
    rows = index.withColumns({"low": F.min("d").over(key), "high": F.max("d").over(key)}).where("low <> high")
    rows = rows.groupBy("key", "d").agg(F.min("node").alias("node"), *(F.first(c).alias(c) for c in ("n", "place", "rares")))
    after = F.collect_list(F.struct("node", "n", "place")).over(key.orderBy("d").rowsBetween(1, s.few - 1))
    rows = rows.withColumns({"members": F.count("*").over(key), "near": after})
    near = F.filter("near", lambda x: (x["node"] != F.col("node")) & _close(s.percent, F.col("n"), F.col("place"), x["n"], x["place"]))
    near = F.when(F.col("members") <= s.few, F.transform(near, lambda x: x["node"]))
    same = F.xxhash64("members", F.bit_xor(F.xxhash64("node")).over(key), F.bit_xor(F.xxhash64("node", F.lit(1))).over(key))
    return rows.withColumns({"near": near, "same": same}).where((F.col("members") > s.few) | (F.size("near") > 0)).drop("d")


BLOOM_BITS = 1 << 23


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of fixed size, with two bits for each id: at most BLOOM_BITS / 64 rows reach the
    driver, whatever the number of ids. Where it is full it lets all pass, and only costs time."""
    bits = ids.select(F.explode(F.array(*(F.pmod(F.xxhash64(F.col(column), F.lit(k)), F.lit(BLOOM_BITS)) for k in (1, 2)))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).collect()
    out = np.zeros(BLOOM_BITS // 64, np.uint64)
    for word, mask in words:
        out[word] = mask & 0xFFFFFFFFFFFFFFFF
    return out


def filtered(docs: DataFrame, bloom: np.ndarray, column: str, inside: bool = True, then=None, schema=None) -> DataFrame:
    """Rows whose id the filter lets pass, all of the ids it was made of and a few others; or the rest.
    `then` maps each batch of them, in the same Python worker, to rows of `schema`."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = np.ones(len(batch), bool)
            for k in ("b1", "b2"):
                bit = batch[k].to_numpy(np.int64)
                ok &= (shared.value[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            rows = batch[ok == inside].drop(columns=["b1", "b2"])
            if len(rows):
                yield then(rows) if then else rows

    marked = docs.withColumns({f"b{k}": F.pmod(F.xxhash64(F.col(column), F.lit(k)), F.lit(BLOOM_BITS)) for k in (1, 2)})
    return marked.mapInPandas(run, schema or docs.schema)


def without(docs: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """Rows of docs whose id is not in `gone`, a written table. Rows that a Bloom filter of fixed size
    tells from all of those stay where they are; only the others are shuffled to meet them."""
    bit = {k: F.pmod(F.xxhash64(F.col(column), F.lit(k)), F.lit(BLOOM_BITS)) for k in (1, 2)}
    words = gone.select(F.explode(F.array(*bit.values())).alias("bit")).groupBy(F.shiftright("bit", 6).alias("__word"))
    words = common.materialise(words.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("__bits")), "filter")
    rows = docs
    for k in (1, 2):
        own = F.broadcast(words.select(F.col("__word").alias(f"__word{k}"), F.col("__bits").alias(f"__bits{k}")))  # BLOOM_BITS / 64 rows at most
        rows = rows.withColumn(f"__bit{k}", bit[k]).join(own, F.shiftright(f"__bit{k}", 6) == F.col(f"__word{k}"), "left")
    inside = " and ".join(f"coalesce(shiftright(__bits{k}, cast(__bit{k} & 63 as int)) & 1L, 0L) = 1" for k in (1, 2))
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = rows.withColumn("__inside", F.expr(inside))
    return rows.where("not __inside").select(own).union(rows.where("__inside").select(own).join(gone, column, "left_anti").select(own))


def word_shingles(text: str, words: int) -> set:
    """The set itself, of tuples of words."""
    w = text.encode().translate(FOLD).split()
    return set(zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else {tuple(w)} if w else set()


def _verified(pairs: DataFrame, docs: DataFrame, s: JaccardSettings) -> DataFrame:
    """a, b of the pairs that link. Of pairs with the same a, `chunk` at a time follow its text in one
    group, so a task holds two sets, and an a with very many partners is split."""
    spark = pairs.sparkSession
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = filtered(docs.select("node", "text"), id_filter(nodes, "node"), "node")
    # Rows of one node are copies; told apart by a second hash, two texts under one hash would both be compared.
    texts = common.materialise(texts.join(nodes, "node").withColumn("check", F.xxhash64("text", F.lit(1))).dropDuplicates(["node", "check"]).drop("check"), "texts")
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / s.chunk).alias("chunks"))
    pairs = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
    firsts = pairs.select("a", "chunk").distinct().join(texts.select(F.col("node").alias("a"), "text"), "a").select("a", "chunk", F.lit(0).cast("long").alias("b"), F.lit(True).alias("first"), "text")
    others = pairs.join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "chunk", "b", F.lit(False).alias("first"), "text")
    rows = firsts.union(others).repartition(common.partitions(spark), "a", "chunk").sortWithinPartitions("a", "chunk", F.desc("first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, firsts = None, []
        for batch in batches:
            found = []
            for a, chunk, b, first, text in zip(*(batch[c].tolist() for c in ("a", "chunk", "b", "first", "text")), strict=True):
                if group != (a, chunk):
                    group, firsts = (a, chunk), []
                tokens = word_shingles(text, s.words)
                if first:
                    firsts.append(tokens)
                    continue
                for x in firsts:
                    both = len(x & tokens)
                    if 100 * both >= s.percent * (len(x) + len(tokens) - both):
                        found.append((a, b))
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return rows.mapInPandas(run, "a long, b long")


def _close(percent: int, n, place, m, other):
    """Whether sets of n and m tokens that share none before these places can link."""
    most = F.least(n - place, m - other)
    return 100 * most >= percent * (n + m - most)


def _alike(pairs: DataFrame, bits: DataFrame, s: JaccardSettings) -> DataFrame:
    """a, b of the pairs whose parity bits don't rule a link out: of n + m tokens in two linked sets, at
    most a share of (100 - percent) / (100 + percent) is in one set alone."""
    for x in ("a", "b"):
        pairs = pairs.join(bits.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")), x)
    return _alike_long(pairs.where(_within(F.col("bits_a"), F.col("bits_b"), s)).select("a", "b"), bits, s)


def _within(p, q, s: JaccardSettings):
    """Whether two sets' parity bits, equally many, leave room for a link."""
    apart = F.aggregate(F.zip_with(p, q, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return (100 + s.percent) * apart <= (100 - s.percent) * (F.col("n_a") + F.col("n_b"))


def _alike_long(pairs: DataFrame, bits: DataFrame, s: JaccardSettings) -> DataFrame:
    """The same by the bits of long sets. Where one has twice as many, its halves are laid over each other,
    which gives the bits of half the size; pairs of other sizes pass."""
    wide = bits.where("wide is not null")
    for x in ("a", "b"):
        pairs = pairs.join(wide.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"wide_{x}")), x, "left")
    p, q = F.col("wide_a"), F.col("wide_b")

    def halved(w):
        half = (F.size(w) / 2).cast("int")
        return F.zip_with(F.slice(w, F.lit(1), half), F.slice(w, half + 1, half), lambda x, y: x.bitwiseXOR(y))

    fits = F.when(F.size(p) == F.size(q), _within(p, q, s)).when(F.size(p) == 2 * F.size(q), _within(halved(p), q, s)).when(2 * F.size(p) == F.size(q), _within(p, halved(q), s)).otherwise(True)
    return pairs.where(p.isNull() | q.isNull() | fits).select("a", "b")


def _with_pivot(rows: DataFrame, s: JaccardSettings) -> tuple[DataFrame, DataFrame]:
    """(pairs of each key's pivot with its other members, the rows without the pivots)."""
    pivots = rows.groupBy("key").agg(F.min(F.struct("rares", "node", "n", "place", "component")).alias("p"))
    both = rows.join(pivots, "key")
    pairs = both.where((F.col("node") != F.col("p.node")) & (F.col("component") != F.col("p.component")) & _close(s.percent, F.col("n"), F.col("place"), F.col("p.n"), F.col("p.place")))
    return pairs.select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct(), both.where(F.col("node") != F.col("p.node")).select(*rows.columns)


def _rest(rows: DataFrame, bits: DataFrame, s: JaccardSettings) -> DataFrame:
    """a, b: all pairs of a key's members of different components that can link, by places and parity
    bits. A key of more than a block of members is split into pairs of blocks, each a group of its own."""
    members = rows.groupBy("key").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks"))
    rows = rows.join(members, "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    one = rows.where("blocks = 1").withColumn("other", F.col("block"))
    many = rows.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = one.union(many).select("key", "node", "n", "place", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    rows = rows.join(bits.select("node", "bits"), "node")
    rows = rows.repartition(common.partitions(rows.sparkSession), "key", "low", "high").sortWithinPartitions("key", "low", "high", "node")

    def pairs(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        node, n, place, component = (g[c].to_numpy(np.int64) for c in ("node", "n", "place", "component"))
        bits = np.stack(g["bits"].to_list()).view(np.uint64)  # of signed numbers numpy counts the absolute value's bits
        split, block = g["low"].iloc[0] != g["high"].iloc[0], g["block"].to_numpy()
        step = max(1, 500_000 // len(g))
        for a in range(0, len(g), step):
            i = slice(a, a + step)
            most = np.minimum((n - place)[i, None], (n - place)[None, :])
            ok = (component[i, None] != component[None, :]) & (100 * most >= s.percent * (n[i, None] + n[None, :] - most)) & (np.arange(len(g))[i, None] < np.arange(len(g))[None, :])
            if split:
                ok &= block[i, None] != block[None, :]
            x, y = np.nonzero(ok)
            near = np.zeros(len(x), bool)
            for c in range(0, len(x), 100_000):
                p, q = a + x[c : c + 100_000], y[c : c + 100_000]
                apart = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64)
                near[c : c + 100_000] = (100 + s.percent) * apart <= (100 - s.percent) * (n[p] + n[q])
            x, y = x[near], y[near]
            yield pd.DataFrame({"a": node[a + x], "b": node[y]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = held.iloc[-1]
            whole = ~((held["key"] == last["key"]) & (held["low"] == last["low"]) & (held["high"] == last["high"]))
            found = [x for _, g in held[whole].groupby(["key", "low", "high"], sort=False) if len(g) > 1 for x in pairs(g)]
            held = held[~whole]
            if found:
                yield pd.concat(found)
        if held is not None and len(held) > 1:
            yield from pairs(held)

    return rows.mapInPandas(run, "a long, b long").distinct()


def _components(keys: DataFrame, docs: DataFrame, sets: DataFrame, s: JaccardSettings) -> DataFrame:
    """node, component of the sets that link."""
    links = joined = None
    # Of keys with the same members one stays, with each member's first place: copies share hundreds.
    rows = keys.where(F.col("members") > s.few).groupBy(F.col("same").alias("key"), "node").agg(F.first("n").alias("n"), F.min("place").alias("place"), F.first("rares").alias("rares"))
    rows = common.materialise(rows, "large-keys")
    nodes = keys.select("node").union(keys.select(F.explode("near"))).distinct()
    bits = sets.join(nodes, "node").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("wide").alias("wide"))
    bits = common.materialise(bits, "parity-bits")
    used = [bits, rows]
    for turn in range(s.pivots + 1):
        if joined is not None:
            known = joined.withColumnRenamed("component", "__known")
            rows = rows.drop("component").join(known, "node", "left").withColumn("component", F.coalesce("__known", "node")).drop("__known")
            rows = common.materialise(rows, "placed-keys")  # read twice below: the join is made once
            used.append(rows)
            spread = rows.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
            rows = common.materialise(rows.join(spread, "key"), "open-keys")
            used.append(rows)
            if rows.isEmpty():
                break
        else:
            rows = rows.withColumn("component", F.col("node"))
        if turn < s.pivots:
            pairs, rows = _with_pivot(rows, s)
            if turn == 0:
                pairs = pairs.union(keys.select("node", F.explode("near").alias("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            pairs = _alike(pairs, bits, s)
        else:
            pairs = _alike_long(_rest(rows, bits, s), bits, s)
        pairs = common.materialise(pairs, "pairs")
        if joined is not None and pairs.isEmpty():
            common.discard(pairs)
            continue
        found = common.materialise(_verified(pairs, docs, s), "links")
        common.discard(pairs)
        links = found if links is None else links.union(found)
        joined = common.materialise(components(links, "a", "b"), "components")
    common.discard(*used)
    return joined


def jaccard_groups(docs: DataFrame, settings: JaccardSettings = JaccardSettings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links).

    Equal sets are one class, told by a 128-bit digest. Each distinct set is indexed under the keys of
    its whole prefix (see the module's text), so no linked pair is missed, whatever the lengths; sets
    that meet are compared word by word. n_shingles counts distinct 64-bit hashes.

    Null and empty texts have no shingles and their own component. Rows that repeat an id are compared
    each by its own text. Rows with a null id are members like others, but their id is nobody's
    component; a component without an id is null. An empty table gives an empty result. Other columns are ignored.
    """
    s, spark = settings, docs.sparkSession
    common.small_batches(spark, size="4m")  # arrays over a batch's tokens take many times its bytes
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), common.empty_text(text_column).alias("text"))
    docs = docs.withColumn("node", F.xxhash64("doc_id", "text"))
    summaries = common.materialise(_summaries(docs, s), "summaries")
    rows = summaries.where("kind = 0").drop("kind")
    frequent = _frequent(summaries, rows.count(), s)
    keys = common.materialise(_shared_keys(_index(docs, frequent, s), s), "shared-keys")
    joined = _components(keys, docs, rows.select("node", "n", "bits", "wide"), s)
    common.discard(keys)
    classes = rows.where("n > 0").groupBy("d0", "d1").agg(F.min("doc_id").alias("low"))
    named = joined.join(rows.select("node", "d0", "d1").distinct(), "node").select("d0", "d1", "component").distinct()
    classes = classes.join(named, ["d0", "d1"], "left")
    lows = classes.where("component is not null").groupBy("component").agg(F.min("low").alias("lowest"))
    classes = classes.join(lows, "component", "left").select("d0", "d1", F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("lowest")).alias("component_id"), F.lit(True).alias("__set"))
    out = rows.join(classes, ["d0", "d1"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("__set"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, settings: JaccardSettings = JaccardSettings(words=5, percent=80), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without those whose component has a smaller id. Rows without an
    id stay."""
    groups = jaccard_groups(docs, settings, id_column, text_column)
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_column] == gone["__gone"], "left_anti")


def keep_one_of_each(docs: DataFrame, settings: JaccardSettings = JaccardSettings(words=5, percent=80), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of linked rows, all columns: that of the smallest id, null ids last.

    Rows are told apart by a key of their own, not by their id: repeated rows and copies without an id
    are compared as all others, and unlinked texts under one id both stay. Rows without shingles are
    groups of their own.
    """
    row = "__row"
    docs = common.materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-rows")  # written once: the key stays
    groups = jaccard_groups(docs.select(row, text_column), settings, row, text_column).select(F.col("doc_id").alias(row), "component_id")
    groups = common.materialise(groups.join(docs.select(row, F.col(id_column).alias("__id")), row), "row-groups")
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", row)).alias("first")
    shared = groups.groupBy("component_id").agg(F.count("*").alias("n"), first).where("n > 1").select("component_id", F.col(f"first.{row}").alias("__first"))
    gone = common.materialise(groups.join(shared, "component_id").where(F.col(row) != F.col("__first")).select(row), "rows-gone")
    return without(docs, gone, row).drop(row)
