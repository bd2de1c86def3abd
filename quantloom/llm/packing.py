"""Operator 10: packing documents into sequences by linear grouping and best fit."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm import common
from quantloom.llm.tokens import chunk_encoder

#: A bin type: [how many bins, [(length, copies), ...] in their order].
Bins = list[list]


def group_up(lengths: dict[int, int], groups: int) -> dict[int, list[tuple[int, int]]]:
    """Groups of equal cardinality, in order of length: the group's largest length, to which its
    members are rounded up, and its (length, count) runs, the longest first."""
    total, out = sum(lengths.values()), {}
    step = max(1, -(-total // groups))
    runs, room = [], step
    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            take = min(left, room)
            runs.append((length, take))
            left, room = left - take, room - take
            if not room:
                out.setdefault(runs[0][0], []).extend(runs)
                runs, room = [], step
    if runs:
        out.setdefault(runs[0][0], []).extend(runs)
    return out


def fullest(sizes: list[int], counts: list[int], capacity: int) -> dict[int, int]:
    """The configuration with the largest sum up to the capacity that holds the first size still left.

    reach[s] tells with which last size, in descending order, the sum s was first reached; a size is
    taken no more often than it is there.
    """
    first = next(i for i, n in enumerate(counts) if n)
    base = sizes[first]
    reach: dict[int, tuple[int, int]] = {base: (-1, first)}
    for i in range(first, len(sizes)):
        left = counts[i] - (i == first)
        frontier = list(reach)
        for _ in range(min(left, (capacity - base) // sizes[i])):
            new = [s + sizes[i] for s in frontier if s + sizes[i] <= capacity and s + sizes[i] not in reach]
            if not new:
                break
            for s in new:
                reach[s] = (s - sizes[i], i)
            frontier = new
        if capacity in reach:
            break
    at, used = max(reach), defaultdict(int)
    while at != -1:
        at, i = reach[at]
        used[i] += 1
    return dict(used)


def configurations(groups: dict[int, list[tuple[int, int]]], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, sizes used) until every size is used up: each time the configuration that leaves the least room of
    all with the largest size still there, as often as its sizes last."""
    sizes = sorted(groups, reverse=True)
    counts = [sum(n for _, n in groups[s]) for s in sizes]
    out = []
    while any(counts):
        used = fullest(sizes, counts, capacity)
        times = min(counts[i] // k for i, k in used.items())
        for i, k in used.items():
            counts[i] -= times * k
        out.append((times, {sizes[i]: k for i, k in used.items()}))
    return out


def substitute(groups: dict[int, list[tuple[int, int]]], plan: list[tuple[int, dict[int, int]]]) -> Bins:
    """Bins of real lengths: each slot of a configuration takes its group's documents in order, and a
    configuration splits where a run of equal lengths ends."""
    queues = {s: [list(run) for run in reversed(runs)] for s, runs in groups.items()}
    bins: Bins = []
    for times, used in plan:
        slots = [s for s, k in used.items() for _ in range(k)]
        taken = []  # for each slot, runs that sum to `times`
        for s in slots:
            need, runs = times, []
            while need:
                length, n = queues[s][-1]
                take = min(n, need)
                runs.append([length, take])
                need -= take
                queues[s][-1][1] -= take
                if not queues[s][-1][1]:
                    queues[s].pop()
            taken.append(runs[::-1])
        while taken and taken[0]:
            n = min(runs[-1][1] for runs in taken)
            content: dict[int, int] = defaultdict(int)
            for runs in taken:
                content[runs[-1][0]] += 1
                runs[-1][1] -= n
                if not runs[-1][1]:
                    runs.pop()
            bins.append([n, list(content.items())])
    return bins


def best_fit(bins: Bins, small: dict[int, int], capacity: int) -> Bins:
    """Put small lengths, the longest first, where they leave least room; bins of one kind are filled
    together. New bins are opened when nothing fits."""
    by_room: dict[int, Bins] = defaultdict(list)
    for n, content in bins:
        by_room[capacity - sum(a * k for a, k in content)].append([n, content])
    for length in sorted(small, reverse=True):
        left = small[length]
        for room in sorted(r for r in by_room if r >= length):
            fits, kinds = room // length, by_room[room]
            while left and kinds:
                n, content = kinds.pop()
                whole = min(n, left // fits)
                if whole:
                    by_room[room - fits * length].append([whole, [*content, (length, fits)]])
                    left -= whole * fits
                rest = n - whole
                if rest and left:  # fewer than `fits` are left
                    by_room[room - left * length].append([1, [*content, (length, left)]])
                    left, rest = 0, rest - 1
                if rest:
                    kinds.append([rest, content])
                    break
            if not left:
                break
        if left:
            fits = capacity // length
            if left // fits:
                by_room[capacity - fits * length].append([left // fits, [(length, fits)]])
            if left % fits:
                by_room[capacity - left % fits * length].append([1, [(length, left % fits)]])
    return [x for kinds in by_room.values() for x in kinds]


#: Numbers of groups, of which the one that needs the fewest bins is taken. With many, a group has few lengths, and
#: rounding up costs little; there are never more sizes than lengths.
GROUPS = (128, 1024, 65_536)


def plan_bins(lengths: dict[int, int], capacity: int, small_share: int = 6) -> Bins:
    """Bins for all pieces, told by how many there are of each length.

    Lengths above capacity / small_share are grouped and rounded up, so a configuration has fewer than `small_share`
    pieces; every one of them is placed by a configuration, and the real lengths take the rounded ones' places.
    The smaller ones fill what is left. Every number of groups is planned, on numbers alone.
    """
    large = {a: n for a, n in lengths.items() if a * small_share > capacity}
    small = {a: n for a, n in lengths.items() if a not in large}
    plans = []
    for groups in GROUPS if large else (1,):
        grouped = group_up(large, groups) if large else {}
        plans.append(best_fit(substitute(grouped, configurations(grouped, capacity)), small, capacity))
    return min(plans, key=lambda bins: sum(n for n, _ in bins))


def placements(bins: Bins) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, copies in a sequence, offset): the documents of one
    length, ranked from 0, are dealt to the bins in this order."""
    out, next_rank, sequence = [], defaultdict(int), 0
    for n, content in bins:
        offset = 0
        for length, copies in content:
            out.append((length, next_rank[length], n * copies, sequence, copies, offset))
            next_rank[length] += n * copies
            offset += length * copies
        sequence += n
    return out


def in_rank_blocks(places: list[tuple[int, int, int, int, int, int]]) -> tuple[dict[int, int], list[tuple]]:
    """A block width for each length, and the placements by (length, block of ranks): so that few placements share a
    block, and a placement lies in few blocks. There are at most twice as many rows as placements, and one a length."""
    ranks, kinds = defaultdict(int), defaultdict(int)
    for length, _, n, *_ in places:
        ranks[length] += n
        kinds[length] += 1
    width = {a: max(1, 2 * ranks[a] // kinds[a]) for a in ranks}
    return width, [(p[0], block, *p[1:]) for p in places for block in range(p[1] // width[p[0]], (p[1] + p[2] - 1) // width[p[0]] + 1)]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text", lean: bool = False) -> DataFrame:
    """Ids of each whole text and an end id, cut only if longer than the capacity: then into pieces of
    the capacity, and the first piece is what is over. One row per piece; no shuffle."""
    common.small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = chunk_encoder(tokenizer, True) if lean else chunk_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["doc_id"], encoder.encode(batch["text"].tolist()), strict=True):
                ids += end
                total = len(ids) // 4
                cuts = [0, *range(total % capacity or capacity, total + 1, capacity)] if total > capacity else [0, total]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc, k, a, b - a, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype("i4")] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]).astype({"doc_id": "Int64"})

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), common.empty_text(text_column).alias("text")).mapInPandas(run, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text", lean: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence that holds each, and its offset there.

    Only the number of pieces of each length, at most `capacity` numbers, reaches the driver, which
    plans bins for lengths; the plan's size depends on the capacity, not on the documents. Pieces of
    one length get consecutive ranks from counts per (length, hash bucket), so no group of equal
    lengths meets in one task, and a rank's place follows from the plan. A null text is an end id
    alone; repeated rows are packed each; an empty table gives no rows. With `lean` the encoders take
    less memory and more time.
    """
    spark = docs.sparkSession
    pieces = token_pieces(docs, tokenizer, end_id, capacity, with_ids, id_column, text_column, lean)
    buckets = max(64, common.partitions(spark))
    pieces = common.materialise(pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")), "pieces")
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if not lengths:
        return pieces.drop("bucket").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    places = placements(plan_bins(lengths, capacity))
    before = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    in_bucket = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("rank", in_bucket - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))
    width, blocks = in_rank_blocks(places)
    plan = spark.createDataFrame(blocks, "length long, block long, p_rank long, p_n long, p_sequence long, p_copies long, p_offset long")
    widths = spark.createDataFrame(list(width.items()), "length long, width long")
    at = F.col("rank") - F.col("p_rank")
    # The plan's size is bounded by the capacity, so it may be broadcast.
    ranked = ranked.join(F.broadcast(widths), "length").withColumn("block", F.floor(F.col("rank") / F.col("width")))
    out = ranked.join(F.broadcast(plan), ["length", "block"]).where((at >= 0) & (at < F.col("p_n")))
    out = out.withColumns({"sequence_id": F.col("p_sequence") + F.floor(at / F.col("p_copies")), "offset": F.col("p_offset") + F.pmod(at, F.col("p_copies")) * F.col("length")})
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset")
