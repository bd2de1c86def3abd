"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Temporary folders of sessions on one machine, by application.
_LOCAL: dict[str, str] = {}

#: Written tables and where they are, until they are discarded.
_WRITTEN: dict[int, tuple[DataFrame, str]] = {}

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share."""
    return stable_folder(spark, f"{name}-{uuid.uuid4().hex}")


def stable_folder(spark: SparkSession, name: str) -> str:
    """A folder under spark.checkpoint.dir that keeps its name from run to run.

    Where the setting is absent a temporary folder takes its place, but only if driver and executors
    are one process: on a cluster they wouldn't share it, and that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="quantloom-")
    return f"{root.rstrip('/')}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back: what follows doesn't compute it again."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = (out, path)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more. Those of a store that the driver can't
    open by itself stay."""
    for frame in frames:
        _, path = _WRITTEN.pop(id(frame))
        try:
            store, place = filesystem(path)
            store.delete_dir(place)
        except (OSError, ValueError, NotImplementedError):
            continue


def written() -> list[DataFrame]:
    """Tables of materialise() that are not discarded yet."""
    return [frame for frame, _ in _WRITTEN.values()]


def discard_unread(frames: list[DataFrame], reader: DataFrame) -> list[DataFrame]:
    """Discard the frames that `reader` does not read, and return those that it does."""
    files, still = reader.inputFiles() if frames else [], []
    for frame in frames:
        if id(frame) in _WRITTEN:
            folder = f"/{_WRITTEN[id(frame)][1].rpartition('/')[2]}/"
            if any(folder in x for x in files):
                still.append(frame)
            else:
                discard(frame)
    return still


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Bound the Arrow batches sent to Python, by rows and by bytes: texts can be long.

    A frame that is returned runs later, so its session's setting is lowered for good; one that is
    lower already stays."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(now, rows) if now > 0 else rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def join_sized(rows: DataFrame, sized: DataFrame, on: list[str], count: str, total: int, parts: int = 2000) -> DataFrame:
    """rows joined with sized, which has one row per key and the number of rows that hold it, of `total`
    in all. Keys with a `parts`-th of the rows or more are at most `parts`, so those are broadcast and
    their rows stay where they are; the rows of the others are shuffled, none of which fills a task."""
    hot = F.col(count) * parts >= total
    heavy = F.broadcast(sized.where(hot))
    return rows.join(heavy.select(on), on, "left_anti").join(sized.where(~hot), on).unionByName(rows.join(heavy, on))


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def empty_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
