"""Exact quantiles of any number of groups, without a task that holds a group's values.

Rows are counted by group and value first, so a hot group is spread by its values and equal ones
meet before the shuffle. Counts in narrow buckets of a monotone scale then tell in which bucket each
asked rank lies, and only the values of those buckets are put in order. Both steps read the same
shuffled counts. Counts of buckets add up, so a group can also be a window of others: rows are not
copied into the windows that they belong to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Buckets per unit of the logarithm of one and the value.
FINENESS = 256


def _bucket(v: Column) -> Column:
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * FINENESS)).cast("long")


def join_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys that may be null, each key kept once."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, on).drop(*[f"_r_{k}" for k in keys])


def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], windows: DataFrame | None = None) -> DataFrame:
    """``(*keys, rows, n, q)``: all rows, those with a value, and the interpolated quantiles.

    Nulls of the value have no rank, nulls of keys are a group. A group without values has null
    quantiles; a table without rows has no groups unless ``keys`` is empty, which gives one row.
    Ties count as often as they occur. ``windows`` has the keys and further columns, one row for
    each window that a group belongs to; windows then take the groups' place in the result.
    """
    to = [c for c in windows.columns if c not in keys] if windows is not None else keys
    values = df.select(*keys, F.col(value).cast("double").alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_n")).withColumn("_b", _bucket(F.col("_v")))
    hist = values.groupBy(*keys, "_b").agg(F.sum("_n").alias("c"))
    if windows is not None:
        hist = join_keys(hist, windows, keys).groupBy(*to, "_b").agg(F.sum("c").alias("c"))
    group, known = W.partitionBy(*to), F.when(F.col("_b").isNotNull(), F.col("c")).otherwise(0)
    upto = group.orderBy(F.col("_b").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    hist = hist.select(*to, "_b", "c", F.sum(known).over(upto).alias("to"), F.sum(known).over(group).alias("n"), F.sum("c").over(group).alias("rows"))
    at = lambda p: (F.col("n") - 1) * F.lit(p)
    ranks = F.array(*[F.struct(F.lit(2 * i + k).alias("i"), f(at(p)).cast("long").alias("rank")) for i, p in enumerate(probs) for k, f in enumerate((F.floor, F.ceil))])
    first = F.col("to") - F.col("c")
    here = F.filter(ranks, lambda r: (r["rank"] >= first) & (r["rank"] < F.col("to")))
    asked = hist.where("_b is not null").select(*to, "_b", F.transform(here, lambda r: F.struct(r["i"].alias("i"), (r["rank"] - first).alias("place"))).alias("places")).where(F.size("places") > 0)
    if windows is None:
        held = join_keys(values, asked, [*keys, "_b"])
    else:
        held = join_keys(values, join_keys(asked, windows, to), [*keys, "_b"]).groupBy(*to, "_b", "_v").agg(F.sum("_n").alias("_n"), F.first("places").alias("places"))
    inside = W.partitionBy(*to, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    held = held.select(*to, "_v", "_n", "places", F.sum("_n").over(inside).alias("hi"))
    found = held.select(*to, "_v", F.explode(F.filter("places", lambda p: (p["place"] < F.col("hi")) & (p["place"] >= F.col("hi") - F.col("_n")))).alias("p"))
    nothing = lambda t: F.lit(None).cast(t)
    both = hist.groupBy(*to).agg(F.max("rows").alias("rows"), F.max("n").alias("n")).select(*to, "rows", "n", nothing("int").alias("i"), nothing("double").alias("v"))
    both = both.unionByName(found.select(*to, nothing("long").alias("rows"), nothing("long").alias("n"), F.col("p.i").alias("i"), F.col("_v").alias("v")))
    ends = [F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"_e{i}") for i in range(2 * len(probs))]
    out = both.groupBy(*to).agg(F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("n"), *ends)
    part = lambda p: at(p) - F.floor(at(p))
    end = lambda i: F.col(f"_e{i}")
    mixed = [F.when(end(2 * i) == end(2 * i + 1), end(2 * i)).otherwise((1 - part(p)) * end(2 * i) + part(p) * end(2 * i + 1)) for i, p in enumerate(probs)]
    return out.select(*to, "rows", "n", F.array(*mixed).alias("q"))


def medians(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """``(*keys, rows, one column per measure)``: the groups' rows and each measure's median."""
    each = F.array(*[F.struct(F.lit(n).alias("_m"), v.cast("double").alias("_x")) for n, v in measures.items()])
    mids = quantiles(df.select(*keys, F.inline(each)), [*keys, "_m"], "_x", [0.5])
    return mids.groupBy(*keys).agg(F.max("rows").alias("rows"), *[F.max(F.when(F.col("_m") == n, F.col("q")[0])).alias(n) for n in measures])
