"""Contiguous shards of near-equal byte size from global prefix sums.

Rows are put in the order of their ids by range; each partition sums up its own sizes; the totals of the partitions
before it make its sums global; a row goes to the shard in whose equal share of all bytes its middle lies. Texts are not
shuffled, only their sizes and checksums. One row a partition meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, whole_text

ROW_BYTES = 16


def byte_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    ``size`` is the bytes of the text in UTF-8 (a null text has none) plus 16; ``slot`` counts the rows of a shard from 0 in the order of
    the ids, null ids first, repeated rows next to each other. With fewer rows than shards some shards stay empty."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(whole_text(text_col)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(whole_text(text_col).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "text_crc32", "tie").sortWithinPartitions("doc_id", "text_crc32", "tie").drop("tie")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size, place = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            ends = size + np.cumsum(batch.column(1).to_numpy())
            n = len(ends)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(ends), pa.array(place + np.arange(n))], [*batch.schema.names, "part", "through", "place"])
            size, place = int(ends[-1]) if n else size, place + n

    schema = T.StructType([*ordered.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("through", T.LongType()), T.StructField("place", T.LongType())])
    local = staged(ordered.mapInArrow(sums, schema), "sizes")
    totals = local.groupBy("part").agg(F.max("through").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base_rows"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    # twice the middle of the row, in whole numbers: decimal, as shards x bytes may pass 64 bits
    middle = (2 * (F.col("base") + F.col("through")) - F.col("size")).cast("decimal(20,0)")
    shard = F.expr(f"least({shards - 1}, cast(floor((middle * {shards}) / (2 * cast(all_bytes as decimal(20,0)))) as int))")
    placed = local.join(bases, "part").withColumn("middle", middle).withColumn("shard", shard).withColumn("global_place", F.col("base_rows") + F.col("place"))
    placed = placed.select("doc_id", "size", "text_crc32", "shard", "global_place")
    first = placed.groupBy("shard").agg(F.min("global_place").alias("first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("global_place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
