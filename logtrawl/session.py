"""Session helpers: where intermediate tables go, and how they are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of a join is only ever hinted as broadcast below this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024

_own_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting gets a
    folder of its own, because there driver and executors share one machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="logtrawl-")
    return _own_dirs[context.applicationId]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several later steps need the same matches: the text is then scanned once, the lineage is
    short, and a lost executor costs a re-read instead of a re-scan.
    """
    return write_table(df, name)[0]


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like ``materialize``, with the path, for callers that ``drop`` the table when they are done."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/logtrawl/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that this library wrote, on whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_side(df: DataFrame, name: str, row_bytes: int) -> DataFrame:
    """Write the smaller side of a join and mark it for broadcast if it is small enough, by its real row count.

    Beyond the limit the join stays an ordinary one, which shuffles both sides.
    """
    table = materialize(df, name)
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table
