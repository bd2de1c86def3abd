"""Operator 1: token-id files with 64-bit document offsets."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import common
from quantloom.llm.tokens import chunk_encoder, vocabulary_size

INDEX = "index.json"


def _commit(fs, part: str, path: str) -> None:
    """Give a finished file its name. Another attempt of the task may have left the same content there."""
    from pyarrow.fs import FileType

    if fs.get_file_info(path).type != FileType.NotFound:
        fs.delete_file(path)
    fs.move(part, path)


def _put(fs, path: str, data: bytes, attempt: int) -> None:
    """Write under another name first: a task that is run again leaves whole files only."""
    with fs.open_output_stream(f"{path}.{attempt}.part") as f:
        f.write(data)
    _commit(fs, f"{path}.{attempt}.part", path)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> dict:
    """Encode every text and write flat files of unsigned ids under `folder`, in ascending id order.

    Each range partition p writes `p.ids` (flat ids, the narrowest of 16 or 32 bits that holds the
    vocabulary, little endian), `p.off` (64-bit starts within the file, one more than it has
    documents) and `p.doc` (64-bit document ids). `index.json` adds each file's first global
    document and token, the prefix sums of the partitions' counts. A shard is memory-mapped with
    numpy; a document's place is the shard's base plus its start.

    Null texts count as empty and give the end id alone; rows with the same document id follow each
    other by text; a null document id is refused, since the files can't hold it. An empty table gives
    an index without shards. Other columns are ignored.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    wide = max(vocabulary_size(tokenizer), end_id + 1) > 1 << 16
    kind = "<u4" if wide else "<u2"
    fs, root = common.filesystem(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_column).cast("long").alias("d"), common.empty_text(text_column).alias("t"))
    rows = rows.withColumn("d", F.when(F.col("d").isNull(), F.raise_error(F.lit("a document id is null"))).otherwise(F.col("d")))
    rows = rows.repartitionByRange(common.partitions(spark), "d").sortWithinPartitions("d", "t")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = common.filesystem(folder)
        store.create_dir(base, recursive=True)
        at, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        encoder, end = chunk_encoder(tokenizer), np.array([end_id], kind).tobytes()
        name, counts, ids = f"{base}/{at:06d}", [np.zeros(1, "<i8")], []
        with store.open_output_stream(f"{name}.{attempt}.part") as out:
            for batch in batches:
                parts = []
                for x in encoder.encode(batch["t"].tolist()):
                    parts += [x if wide else np.frombuffer(x, "<u4").astype(kind).tobytes(), end]
                size = np.dtype(kind).itemsize
                counts.append(np.array([(len(a) + len(b)) // size for a, b in zip(parts[::2], parts[1::2], strict=True)], "<i8"))
                ids.append(batch["d"].to_numpy("<i8"))
                out.write(b"".join(parts))
        if not ids:
            store.delete_file(f"{name}.{attempt}.part")
            return
        starts = np.cumsum(np.concatenate(counts))
        _put(store, f"{name}.off", starts.astype("<i8").tobytes(), attempt)
        _put(store, f"{name}.doc", np.concatenate(ids).tobytes(), attempt)
        _commit(store, f"{name}.{attempt}.part", f"{name}.ids")
        yield pd.DataFrame({"shard": [at], "n_docs": [len(starts) - 1], "n_tokens": [starts[-1]]})

    # One row for each partition: the sums that follow never see documents.
    shards = sorted(rows.mapInPandas(write, "shard long, n_docs long, n_tokens long").collect())
    index = {"dtype": kind, "end_id": end_id, "shards": []}
    docs_before = tokens_before = 0
    for at, n_docs, n_tokens in shards:
        index["shards"].append({"name": f"{at:06d}", "first_doc": docs_before, "first_token": tokens_before, "n_docs": n_docs, "n_tokens": n_tokens})
        docs_before, tokens_before = docs_before + n_docs, tokens_before + n_tokens
    _put(fs, f"{root}/{INDEX}", json.dumps(index | {"n_docs": docs_before, "n_tokens": tokens_before}).encode(), 0)
    return index


def _mapped(store, path: str, kind: str) -> np.ndarray:
    """The file as an array: mapped where the store is local, else read."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False, docs_at_once: int = 2000) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (of little-endian
    32-bit ids), and the ids themselves if asked for. Shards are read in parallel."""
    fs, root = common.filesystem(folder)
    with fs.open_input_file(f"{root}/{INDEX}") as f:
        index = json.loads(f.read())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not index["shards"]:
        return spark.createDataFrame([], schema)
    shards = spark.createDataFrame([(x["name"], x["first_token"]) for x in index["shards"]], "name string, base long").repartition(len(index["shards"]))
    kind = index["dtype"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = common.filesystem(folder)
        for batch in batches:
            for name, first in batch.itertuples(index=False):
                ids, offsets, docs = (_mapped(store, f"{base}/{name}.{x}", k) for x, k in (("ids", kind), ("off", "<i8"), ("doc", "<i8")))
                for i in range(0, len(docs), docs_at_once):
                    starts = offsets[i : i + docs_at_once + 1]
                    each = [ids[a:b].astype("<u4") for a, b in zip(starts[:-1], starts[1:], strict=True)]
                    rows = {"doc_id": docs[i : i + docs_at_once], "start": starts[:-1] + first, "n_tokens": np.diff(starts), "ids_crc32": [zlib.crc32(x.tobytes()) for x in each]}
                    yield pd.DataFrame(rows | ({"ids": [x.astype("i8") for x in each]} if with_ids else {}))

    return shards.mapInPandas(read, schema)
