"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only where none is set (tests, local mode) a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jsc.get() if jsc.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="notemesh-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_written: dict[str, SparkSession] = {}


def clear(spark: SparkSession) -> int:
    """Removes the tables that this session has written; frames that read them can't be used any more. The number of tables."""
    mine = [path for path, session in _written.items() if session is spark]
    for path in mine:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        del _written[path]
    return len(mine)


@atexit.register
def _clear_all() -> None:
    for spark in set(_written.values()):
        try:
            clear(spark)
        except Exception:  # noqa: BLE001 — the session has ended; its tables stay in the checkpoint folder
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    Later stages read the table instead of repeating the plan, prune its
    columns, and survive the loss of executors. `clear` removes the tables; at the
    end of the program it is called for all sessions that still run.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, key: str | None, blocks: int) -> str:
    """Writes `df` as `blocks` folders, by a hash of the key (all rows in one without it), and gives the path for `dealt_block`.

    Tasks that hold one side against all blocks of the other read them from the shared folder, so a side is stored once however many blocks meet it.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written[path] = df.sparkSession
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int") if key else F.lit(0)
    df.withColumn("_block", block).repartition(max(1, blocks), "_block").write.partitionBy("_block").parquet(path)
    return path


def dealt_block(path: str, block: int, columns: list[str]) -> pa.Table | None:
    """One block of a dealt table, read inside a task; None if it has no rows."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    place = f"{place}/_block={block}"
    if system.get_file_info(place).type == fs.FileType.NotFound:
        return None
    return ds.dataset(place, filesystem=system, format="parquet").to_table(columns=columns)


def table_bytes(df: DataFrame) -> int:
    """Size estimate of a plan's output, as the optimizer has it (exact file sizes for scans)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
