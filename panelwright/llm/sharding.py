"""Contiguous byte-balanced shards from global prefix sums.

Each input partition is summed on its own; a prefix sum over the
per-partition totals gives every partition its offset, a running sum inside
the partition gives every row its place, and the global byte axis is cut at
equal targets. A row belongs to the shard in which its middle byte falls.

To assign shards only three narrow columns move: the text is read once,
reduced to its length and checksum, and not shuffled. No key is involved, so a hot source
or a large group of copies cannot gather in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def assign_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", row_overhead: int = 16, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot and the columns in ``keep``.

    - size: UTF-8 bytes of the text plus ``row_overhead``; a null text has none.
    - shard: 0 to n_shards - 1, contiguous in input order; fewer rows than
      shards leave some shards empty; an empty table gives no rows.
    - slot: the row's place in its shard, gapless from 0.
    - Repeated rows, equal or null ids and equal texts are rows like others.
    - Other columns of ``docs``, whatever their names, are not read.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + F.lit(row_overhead)).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            *(F.col(c).alias(f"kept_{c}") for c in keep),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("pos"),
        )
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = (
        placed.groupBy("part")
        .agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
        .select(  # as many rows as input partitions
            "part",
            F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("byte_offset"),
            F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("row_offset"),
            F.sum("part_bytes").over(whole).alias("total"),
        )
    )
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    located = (
        placed.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("pos")) - 1)
        .join(offsets, "part")
        .withColumn("place", F.col("row_offset") + F.col("nth"))
        .withColumn("middle", 2 * (F.col("byte_offset") + F.col("start")) + F.col("size"))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"(middle * {n_shards}) div (2 * total)")).cast("int"))
    )
    first = located.groupBy("shard").agg(F.min("place").alias("first_place"))  # n_shards rows at most
    return located.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first_place")).alias("slot"), *(F.col(f"kept_{c}").alias(c) for c in keep)
    )


def write_shards(docs: DataFrame, n_shards: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write path/shard=K with the columns slot and row (the whole row, so no name can clash), in slot order over a shard's files.

    Here, unlike in assign_shards, whole rows move, once: to the files of their shard.
    """
    rows = assign_shards(docs.withColumn("row_", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), n_shards, id_col, text_col, keep=("row_",))
    placed = rows.select("shard", "slot", F.col("row_").alias("row"))
    placed.repartitionByRange(n_shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
