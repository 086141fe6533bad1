"""Places of rows in a global order, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import discard, saved


def positions(df: DataFrame, order: list[str], by: tuple[str, ...] = (), total: str | None = None) -> DataFrame:
    """Add ``pos`` (place from 0, nulls first, within each group of ``by``) and ``n`` (rows of the group).

    With ``total``, a long column, also ``before`` (its sum over earlier rows of the group) and
    ``whole`` (over all of them). Rows are dealt to ranges of the order; counts and sums of each
    range's groups are added up, and only inside a range are rows numbered. Rows that agree in all
    of ``order`` come in the order in which they were written first, so that a key which holds
    most rows is spread over many ranges too. ``df`` must not have these names or ``_tie`` and ``_part``.
    """
    base = saved(df.withColumn("_tie", F.monotonically_increasing_id()), "order-rows")
    keys = [*by, *order, "_tie"]
    ranges = base.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys]).withColumn("_part", F.spark_partition_id())
    ranges = saved(ranges, "order-ranges")
    discard(base)
    what = F.col(total) if total else F.lit(0)
    sums = ranges.groupBy("_part", *by).agg(F.count("*").alias("_rows"), F.sum(what).cast("long").alias("_sum"))
    group = W.partitionBy(*by)
    earlier = group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    sums = sums.select(
        F.col("_part").alias("_p"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
        zero(F.sum("_rows").over(earlier)).alias("_first"), zero(F.sum("_sum").over(earlier)).alias("_start"),
        F.sum("_rows").over(group).alias("n"), zero(F.sum("_sum").over(group)).alias("whole"),
    )
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inside = W.partitionBy("_part", *by).orderBy(*[F.col(c).asc_nulls_first() for c in (*order, "_tie")])
    out = ranges.withColumn("_row", F.row_number().over(inside))
    if total:
        out = out.withColumn("_sum", zero(F.sum(what).over(inside.rowsBetween(W.unboundedPreceding, -1))))
    out = out.join(sums, same).withColumn("pos", (F.col("_first") + F.col("_row") - 1).cast("long"))
    if total:
        return out.select(*df.columns, "pos", "n", (F.col("_start") + F.col("_sum")).alias("before"), "whole")
    return out.select(*df.columns, "pos", "n")
