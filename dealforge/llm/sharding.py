"""Contiguous shards of near equal bytes, in DataFrame operations only.

Rows stand in order of their id, nulls first; rows with one id follow by hash of their text and
size. Each range of that order is summed, the sums are added up over the ranges, and every row
thereby knows how many bytes stand before it. The whole is cut at equal targets: a row belongs to
the shard in which its middle byte falls, so a cut is off its target by half a row at most.

Cases: a null text has no bytes, and its hash is that of an empty one; every row has an overhead,
so empty texts are spread as well; equal rows are different rows, each in its place; null ids come
first; a text longer than a shard's target is a row like any other, and a shard may then stay
empty; an empty table gives no rows; added columns replace those of the same name in any case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import saved
from .ordering import positions

LAW = "bytes"


def assign(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, overhead: int = 16) -> DataFrame:
    """The columns ``keep`` (default: all) with ``size``, ``text_crc32``, ``shard`` and ``slot`` (place in the shard from 0)."""
    new = ("size", "text_crc32", "shard", "slot")
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(True).alias("row_")).alias("row")
    rows = df.select(row, F.col(f"`{id_col}`").alias("id"), F.crc32(text.cast("binary")).alias("crc"), (F.octet_length(text) + overhead).cast("long").alias("size"))
    placed = positions(rows, ["id", "crc", "size"], total="size")
    middle = F.expr(f"least({shards - 1}, coalesce((2 * before + size) * {shards} div nullif(2 * whole, 0), 0))")
    placed = saved(placed.select("row", "crc", "size", "pos", middle.cast("int").alias("shard")), "shard-rows")
    first = placed.groupBy("shard").agg(F.min("pos").alias("first")).withColumnRenamed("shard", "s")
    out = placed.join(first, F.col("shard") == F.col("s"))  # one row a shard, which Spark broadcasts by its size
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "size", F.col("crc").alias("text_crc32"), "shard", (F.col("pos") - F.col("first")).alias("slot"))


def shard_index(sharded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per shard of ``assign``: ``rows``, ``bytes``, ``first_id`` and ``last_id``."""
    ident = F.col(f"`{id_col}`")
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min_by(ident, "slot").alias("first_id"), F.max_by(ident, "slot").alias("last_id"))


def write_shards(df: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """``df`` as one Parquet folder per shard (``shard=k``), in the order of slots within each file.

    ``files`` tasks (default: shuffle partitions) write ranges of (shard, slot), so a shard may have several files.
    """
    new = ("shard", "slot")
    out = assign(df, shards, id_col, text_col)
    keys = [F.col(c) for c in new]
    out = out.repartitionByRange(files, *keys) if files else out.repartitionByRange(*keys)
    out.sortWithinPartitions(*keys).write.partitionBy("shard").parquet(path)
