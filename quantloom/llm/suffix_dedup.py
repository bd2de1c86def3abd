"""Operator 2: removal of byte strings that occur elsewhere, by a hash-compared suffix sort.

A string of `length` bytes holds, at one of its first half + 1 places, the half-length string with the
smallest hash; equal strings hold it at the same place. So only suffixes that begin at such anchors
are compared, and only those whose anchor string occurs again. Around an anchor, half a length on
each side decides which strings through it occur twice: members with equal surroundings, told by a
128-bit digest, settle each other by count; of the others one for each surrounding is sorted, and what the
sort's hashes say is confirmed byte by byte.

Passages told by words go the same way: each word stands as WIDTH bytes of its hash, so a number of
words is a number of bytes, however short the words are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quantloom.llm import common
from quantloom.llm.jaccard_join import filtered, id_filter
from quantloom.llm.shingles import BASE, INVERSE, mix, powers, slices


#: Bytes of a word's hash.
WIDTH = 8
#: Characters of scripts written without spaces; each counts as a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff"
ALONE, WORD = re.compile(f"[{UNSPACED}]"), re.compile(rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+")


@dataclass(frozen=True)
class SuffixSettings:
    length: int = 400  # even
    block: int = 6_000  # suffixes of one anchor string that a task sorts at once
    words: int | None = None  # if given, passages of so many words are told, in place of `length` bytes

    def __post_init__(self) -> None:
        if self.words is not None:
            object.__setattr__(self, "length", WIDTH * self.words)

    @property
    def half(self) -> int:
        return self.length // 2

    def coded(self, text: str) -> bytes:
        """The bytes that are compared: the text's own, or its words' hashes."""
        if self.words is None:
            return text.encode()
        import xxhash

        found = WORD.findall(text) if not text.isascii() and ALONE.search(text) else text.encode().split()
        return b"".join(map(xxhash.xxh3_64_digest, found))

    def removed(self, text: str, spans) -> list[tuple[int, int]]:
        """Runs of the text's own bytes for spans of coded(). Of a word, all bytes are in a span or it
        stays: parts of it can only agree by chance. The white space after a word goes with it."""
        if self.words is None:
            return merged(spans, len(text.encode()))
        places = [m.span() for m in WORD.finditer(text)]
        whole = merged([{"start": -(-x["start"] // WIDTH), "stop": x["stop"] // WIDTH} for x in spans], len(places))
        ends = [(places[a][0], places[b][0] if b < len(places) else places[-1][1]) for a, b in whole]
        return [(len(text[:a].encode()), len(text[:b].encode())) for a, b in ends]


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best of x[i : i + width] for each i, by doubling."""
    done, out = 1, x
    while 2 * done <= width:
        out = best(out[:-done], out[done:])
        done *= 2
    return best(out[: len(out) - (width - done)], out[width - done :]) if done < width else out


def anchors(texts: list[bytes], s: SuffixSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and hash of every anchor string of some texts."""
    half, data = s.half, np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    none = np.zeros(0, np.int64)
    if len(data) < s.length:
        return none, none, none.astype(np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:], dtype=np.uint64)
    h = mix((sums[half:] - sums[:-half]) * powers(INVERSE, len(data) - half + 1))
    small = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _slide(small, half + 1, np.minimum)  # for each string of `length` bytes
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inside = owner[: len(least)] == owner[s.length - 1 :][: len(least)]
    least[~inside] = 0
    # An anchor is the smallest of some whole string: the best of the minima around it is its own.
    padded = np.concatenate([np.zeros(half, np.uint32), least, np.zeros(half, np.uint32)])
    at = np.flatnonzero(_slide(padded, half + 1, np.maximum) == small)
    text = owner[at]
    return text, at - (ends - [len(t) for t in texts])[text], h[at]


def prefix_hashes(rows: np.ndarray) -> np.ndarray:
    """Hash of the first t bytes of each row, for every t."""
    out = np.zeros((rows.shape[1] + 1, len(rows)), np.uint64)
    for t in range(rows.shape[1]):
        out[t + 1] = out[t] * BASE + rows[:, t].astype(np.uint64) + np.uint64(1)
    return mix(out)


def common_prefix(hashes: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes rows a and b have in common: a binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.minimum(lengths[a], lengths[b])
    for _ in range(int(np.ceil(np.log2(hashes.shape[0]))) + 1):
        mid = (low + high + 1) // 2
        same = hashes[mid, a] == hashes[mid, b]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_order(rows: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Rows in order of their bytes, by a merge sort whose comparisons look for the first byte that
    differs by hash. All runs of a width are merged together: an element's place is its place in its
    run plus that of a binary search in the other."""
    n = len(rows)

    def before(a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        k = common_prefix(hashes, lengths, a, b)
        x = np.where(k < lengths[a], rows[a, np.minimum(k, rows.shape[1] - 1)].astype(np.int64), -1)
        y = np.where(k < lengths[b], rows[b, np.minimum(k, rows.shape[1] - 1)].astype(np.int64), -1)
        return (x < y) | ties & (x == y)

    order, width, spot = np.arange(n), 1, np.arange(n)
    while width < n:
        run = spot // width
        other = np.where(run % 2 == 0, run + 1, run - 1) * width
        low, high = np.minimum(other, n), np.minimum(other + width, n)
        base, left = low.copy(), run % 2 == 0
        while (open_ := low < high).any():
            mid = (low + high) // 2
            i = np.flatnonzero(open_)
            # Elements of a left run go before equal ones of the right run.
            ahead = before(order[mid[i]], order[i], ~left[i])
            low[i] = np.where(ahead, mid[i] + 1, low[i])
            high[i] = np.where(ahead, high[i], mid[i])
        place = spot - run * width + (low - base) + (run - run % 2) * width
        merged = np.empty(n, np.int64)
        merged[place] = order
        order, width = merged, 2 * width
    return order


def repeated_offsets(left: list[bytes], right: list[bytes], s: SuffixSettings, by_bytes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each member of some anchors' groups, the least and the largest number of bytes before the
    anchor at which a string of `length` bytes begins that another member has too; -1 for none.

    left, right: the bytes before the anchor, last first, and those from the anchor on. Sorted
    suffixes with `length` - o bytes in common stand together; among those, equal prefixes of o bytes
    of `left` are found by hash. Every result is confirmed byte by byte; if a hash misled, the order
    and the results are worked out from the bytes themselves (by_bytes).
    """
    n, half = len(left), s.half
    r_len, l_len = np.array([len(x) for x in right]), np.array([len(x) for x in left])
    r = np.frombuffer(b"".join(x.ljust(s.length, b"\0") for x in right), np.uint8).reshape(n, s.length)
    lft = np.frombuffer(b"".join(x.ljust(half, b"\0") for x in left), np.uint8).reshape(n, half)
    r_hash, l_hash = prefix_hashes(r), prefix_hashes(lft)
    order = suffix_order(r, r_len, r_hash)
    shared = common_prefix(r_hash, r_len, order[:-1], order[1:])
    column = np.arange(s.length)
    agree = r[order[:-1]] == r[order[1:]]
    k = np.minimum(shared, s.length - 1)
    true = (agree | (column >= shared[:, None])).all(axis=1) & ((shared == np.minimum(r_len[order[:-1]], r_len[order[1:]])) | ~agree[np.arange(n - 1), k])
    by_bytes = by_bytes or not true.all()
    if by_bytes:
        order = np.array(sorted(range(n), key=lambda i: right[i]), np.int64)
        agree = (r[order[:-1]] == r[order[1:]]) & (column < np.minimum(r_len[order[:-1]], r_len[order[1:]])[:, None])
        shared = np.where(agree.all(axis=1), s.length, agree.argmin(axis=1))
    least, most = np.full(n, -1), np.full(n, -1)
    partner = np.zeros((2, n), np.int64)  # with which a member has its least and its largest one
    for o in range(half + 1):
        run = np.concatenate([[0], np.cumsum(shared < s.length - o)])
        ok = (r_len[order] >= s.length - o) & (l_len[order] >= o)
        who, run = order[ok], run[ok]
        if by_bytes:
            _, key = np.unique(np.array([b"%d:" % q + left[i][:o].hex().encode() for i, q in zip(who, run, strict=True)] or [b""]), return_inverse=True)
            key = key[: len(who)]
        else:
            key = mix(run.astype(np.uint64) * BASE + l_hash[o, who])
        by = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[by][1:] == key[by][:-1])
        a, b = who[by][same], who[by][same + 1]
        for i, j in ((a, b), (b, a)):
            first = least[i] < 0
            least[i[first]] = o
            most[i] = o
            partner[0, i[first]], partner[1, i] = j[first], j
    if not by_bytes:
        for offset, other in ((least, partner[0]), (most, partner[1])):
            i = np.flatnonzero(offset >= 0)
            for c in range(0, len(i), 1000):
                k = i[c : c + 1000]
                o, j = offset[k, None], other[k]
                before, after = np.arange(half) < o, column < s.length - o
                if ((lft[k] != lft[j]) & before).any() or ((r[k] != r[j]) & after).any():
                    return repeated_offsets(left, right, s, by_bytes=True)
    return least, most


def _anchor_table(docs: DataFrame, s: SuffixSettings) -> DataFrame:
    """key (hash of an anchor string), a0 and a1 (digest of its surroundings), uid, pos."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            texts = [s.coded(t) for t in batch["text"]]
            uid = batch["uid"].to_numpy(np.int64)
            for i, end in slices(texts):
                some = texts[i:end]
                text, pos, key = anchors(some, s)
                around = b"".join(xxhash.xxh3_128_digest(some[t][max(0, p - s.half) : p + s.length], seed=min(p, s.half)) for t, p in zip(text.tolist(), pos.tolist(), strict=True))
                around = np.frombuffer(around, "<i8").reshape(-1, 2)
                yield pd.DataFrame({"key": key.astype(np.int64), "a0": around[:, 0], "a1": around[:, 1], "uid": uid[i + text], "pos": pos.astype(np.int32)})

    return docs.select("uid", "text").mapInPandas(run, "key long, a0 long, a1 long, uid long, pos int")


def _sorted_extents(suffixes: DataFrame, docs: DataFrame, s: SuffixSettings) -> DataFrame:
    """uid, start, stop for single members, from the surroundings of one member for each kind."""
    spark, half = docs.sparkSession, s.half
    wanted = suffixes.groupBy("uid").agg(F.collect_list(F.struct("key", "pos", "single", "blocks", "block")).alias("at"))
    texts = filtered(docs.select("uid", "text"), id_filter(suffixes, "uid"), "uid").join(wanted, "uid")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for uid, text, at in zip(batch["uid"], batch["text"], batch["at"], strict=True):
                data = s.coded(text)
                for x in at:
                    p = x["pos"]
                    around = (uid, p, x["single"], data[max(0, p - half) : p][::-1], data[p : p + s.length])
                    rows += [(x["key"], min(x["block"], b), max(x["block"], b), *around) for b in range(x["blocks"])]
            yield pd.DataFrame(rows, columns=["key", "low", "high", "uid", "pos", "single", "left", "right"])

    rows = texts.mapInPandas(cut, "key long, low int, high int, uid long, pos int, single boolean, left binary, right binary")
    rows = rows.repartition(common.partitions(spark), "key", "low", "high").sortWithinPartitions("key", "low", "high", "uid", "pos")

    def extents(group: list) -> pd.DataFrame:
        if len(group) < 2:
            return pd.DataFrame({"uid": [], "start": [], "stop": []}, dtype="int64")
        least, most = repeated_offsets([r.left for r in group], [r.right for r in group], s)
        found = [(r.uid, r.pos - int(b), r.pos + s.length - int(a)) for r, a, b in zip(group, least, most, strict=True) if r.single and a >= 0]
        return pd.DataFrame(found, columns=["uid", "start", "stop"]).astype("int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Whole groups are gathered up to a block's size: they are sorted together, each apart by its anchor.
        waiting: list = []
        last = None
        for batch in batches:
            for r in batch.itertuples(index=False):
                now = (r.key, r.low, r.high)
                if now != last and len(waiting) >= s.block // 4:
                    yield extents(waiting)
                    waiting = []
                elif now != last and last is not None and now[0] == last[0]:
                    yield extents(waiting)  # another pair of blocks of the same anchor
                    waiting = []
                waiting.append(r)
                last = now
        yield extents(waiting)

    return rows.mapInPandas(run, "uid long, start long, stop long")


def _shared_anchors(table: DataFrame, parts: int = 2000) -> DataFrame:
    """The rows of a table of anchors whose key occurs again, with `differ`: whether the surroundings of
    the key's members do. Each row is shuffled once, except those of keys with about a `parts`-th of all
    rows or more: those are counted where they are. Which keys are told as such only affects speed."""
    top = table.agg(F.expr(f"approx_top_k(key, {parts}, {4 * parts})").alias("top"), F.count("*").alias("total")).first()
    hot = [(x["item"],) for x in top["top"] or [] if x["count"] * parts >= top["total"] and x["count"] > 1]
    hot = F.broadcast(table.sparkSession.createDataFrame(hot, "key long")) if hot else None
    marks = {"n": F.count("*"), **{f"{a}_{x}": f(a) for a in ("a0", "a1") for f, x in ((F.min, "low"), (F.max, "high"))}}
    few = table if hot is None else table.join(hot, "key", "left_anti")
    rows = few.withColumns({k: f.over(Window.partitionBy("key")) for k, f in marks.items()})
    if hot is not None:
        many = table.join(hot, "key")
        rows = rows.unionByName(many.join(F.broadcast(many.groupBy("key").agg(*(f.alias(k) for k, f in marks.items()))), "key"))
    differ = (F.col("a0_low") != F.col("a0_high")) | (F.col("a1_low") != F.col("a1_high"))
    return rows.where("n > 1").select(*table.columns, differ.alias("differ"))


def repeated_spans(docs: DataFrame, s: SuffixSettings) -> DataFrame:
    """uid and spans, (start, stop) pairs in any order whose union is to go, for docs with uid, text."""
    shared = common.materialise(_shared_anchors(table := common.materialise(_anchor_table(docs, s), "anchors")), "shared-anchors")
    common.discard(table)
    kinds = shared.groupBy("key", "a0", "a1").agg(F.count("*").alias("n"), F.max("differ").alias("differ"), F.min(F.struct("uid", "pos")).alias("one"))
    kinds = common.materialise(kinds, "surroundings")
    groups = kinds.where("differ").groupBy("key").agg(F.count("*").alias("members"), F.max(F.col("n") == 1).alias("open")).where("open")
    blocks = F.ceil(F.col("members") / s.block).cast("int")
    suffixes = kinds.where("differ").join(groups, "key").select("key", "one.uid", "one.pos", (F.col("n") == 1).alias("single"), blocks.alias("blocks"))
    suffixes = common.materialise(suffixes.withColumn("block", F.pmod(F.xxhash64("uid", "pos"), F.col("blocks")).cast("int")), "suffixes")
    settled = common.join_sized(shared.drop("differ"), kinds.where("n > 1").select("key", "a0", "a1", "n"), ["key", "a0", "a1"], "n", shared.count())
    settled = settled.select("uid", (F.col("pos") - s.half).cast("long").alias("start"), (F.col("pos") + s.length).cast("long").alias("stop"))
    spans = settled.union(_sorted_extents(suffixes, docs, s))
    spans = common.materialise(spans.groupBy("uid").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")
    common.discard(shared, kinds, suffixes)
    return spans


def merged(spans, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes within a text of `size` bytes."""
    out: list[list[int]] = []
    for a, b in sorted((max(0, x["start"]), min(size, x["stop"])) for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(docs: DataFrame, s: SuffixSettings, make, schema) -> DataFrame:
    """make(rows, removed runs of each) for all rows of docs (with uid, text and others). Only texts
    that lose something, and a few others, are shuffled to meet their spans."""
    spans = repeated_spans(docs.select("uid", "text"), s)
    bloom = id_filter(spans, "uid")

    def cut(batch: pd.DataFrame) -> pd.DataFrame:
        return make(batch, [s.removed(t, x) if x is not None and len(x) else [] for t, x in zip(batch["text"], batch["spans"], strict=True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(cut, batches)

    def whole(batch: pd.DataFrame) -> pd.DataFrame:
        return make(batch, [[]] * len(batch))

    kept = filtered(docs, bloom, "uid", inside=False, then=whole, schema=schema)
    hit = filtered(docs, bloom, "uid").join(spans, "uid", "left")
    return kept.union(hit.select(*docs.columns, "spans").mapInPandas(run, schema))


def _kept(text: str, runs: list[tuple[int, int]]) -> bytes:
    data, at, parts = text.encode(), 0, []
    for a, b in runs:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def removal_report(docs: DataFrame, settings: SuffixSettings = SuffixSettings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, the kept text (a character
    that a cut goes through is left out of it) and whether anything was removed.

    Every byte is removed that lies in a string of `length` bytes found at another place too, in the
    same text or another; places are judged on the input. With `words` set it is whole words that are
    removed, those in a passage of so many found at another place. Null texts count as empty. Rows are
    told apart by a number of their own, so rows that repeat an id, or a whole row, are copies of one
    another, and null ids come back null. An empty table gives an empty result. Other columns are ignored.
    """
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), common.empty_text(text_column).alias("text"), F.monotonically_increasing_id().alias("uid"))
    rows = common.materialise(rows, "numbered-texts").withColumn("id", F.struct("doc_id"))  # written once: the number stays

    def make(batch: pd.DataFrame, runs: list) -> pd.DataFrame:
        left = [_kept(t, x) for t, x in zip(batch["text"], runs, strict=True)]
        n = [len(t.encode()) for t in batch["text"]]
        gone = [a - len(b) for a, b in zip(n, left, strict=True)]
        return pd.DataFrame({"id": batch["id"], "n_bytes": n, "n_removed": gone, "n_spans": [len(x) for x in runs], "kept_sha256": [hashlib.sha256(x).hexdigest() for x in left], "kept_text": [x.decode("utf-8", "ignore") for x in left], "changed": [x > 0 for x in gone]})

    out = _cut(rows.drop("doc_id"), settings, make, "id struct<doc_id: bigint>, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, changed boolean")
    return out.select("id.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "changed")


def drop_repeated_strings(docs: DataFrame, settings: SuffixSettings = SuffixSettings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The same rows and columns with what removal_report() counts cut out of the text. A character
    that a cut goes through is dropped whole; null texts stay null. Rows are told apart by a number of
    their own: repeated rows are copies of one another."""
    common.small_batches(docs.sparkSession)
    inner = docs.select(F.monotonically_increasing_id().alias("uid"), common.empty_text(text_column).alias("text"), F.col(text_column).isNull().alias("absent"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_column]).alias("row"))
    inner = common.materialise(inner, "numbered-texts")  # written once: the number stays

    def make(batch: pd.DataFrame, runs: list) -> pd.DataFrame:
        text = [None if gone else _kept(t, x).decode("utf-8", "ignore") if x else t for t, x, gone in zip(batch["text"], runs, batch["absent"], strict=True)]
        return pd.DataFrame({"row": batch["row"], "text": text})

    schema = StructType([inner.schema["row"], StructField("text", StringType())])  # null texts come back null
    out = _cut(inner, settings, make, schema)
    return out.select(*[F.col("text").alias(c) if c == text_column else F.col(f"row.`{c}`") for c in docs.columns])
