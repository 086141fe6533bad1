"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source gets a target number of words. A document's expected copies are its source's target
over the source's size: the whole part is certain, the rest is the inclusion probability of one
more copy. Documents are ranked by random odds over inclusion odds and taken in that order up to
the source's remaining words; one more document may then fill the gap that is left. All documents
of a source have one inclusion probability, its target being for the source as a whole, so odds
differ between sources only and each source has a cut of its own: a common cut over all sources
would keep the total, not the targets.

The cut is a boundary on (rank, id) per source, found by a histogram of the random numbers and an
exact running sum inside the one bucket in which the source's words run out. So no task sorts a
source, however many rows it holds.

Cases: a null text has no words; a null source is a source of its own, last in order; a null id
takes part like any other; rows that share source and id are taken together or not at all; an
empty table gives an empty plan; texts are counted whole whatever their length; added columns
replace those of the same name in ``mix``, and ``mixed_rows`` keeps every column whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, fresh, saved, without

BUCKETS = 1024
#: A plan of at most so many sources is broadcast; a longer one is joined as it comes.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(id_col: str, seed: str) -> Column:
    """A number in (0, 1) that depends on id and seed alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(totals: DataFrame, source_col: str, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Add ``target`` to one row per source with its ``source_size``.

    The level at which shares by weight, held at ``cap`` times each source's size, add up to
    ``share`` times all sizes. One row per source passes through one ordering.
    """
    place = F.row_number().over(W.orderBy(F.col(source_col).asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    df = totals.withColumns({"_w": w, "_cap": F.col("source_size") * cap})
    everything = W.partitionBy()
    filling = W.orderBy(F.col("_cap") / F.col("_w"), F.col(source_col).asc_nulls_last())
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumns({
        "_all": F.sum("source_size").over(everything) * share,
        "_wall": F.sum("_w").over(everything),
        "_cap_before": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_w_before": F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
    })
    df = df.withColumn("_level", (F.col("_all") - F.col("_cap_before")) / (F.col("_wall") - F.col("_w_before")))
    settled = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    df = df.withColumn("_level", F.first(settled, ignorenulls=True).over(filling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return df.select(source_col, "source_size", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def plan_mix(sized: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """One row per source: size, target, whole copies, and the boundary of those taken once more."""
    df = sized.select(F.col(source_col).alias("_s"), F.col(id_col).alias("_id"), F.col(size_col).cast("long").alias("_n"), _draw(id_col, seed).alias("_u"))
    totals = df.groupBy("_s").agg(F.sum("_n").alias("source_size"))
    plan = targets(totals, "_s", weights, share, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(ratio).cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = plan.withColumn("odds", F.when(F.col("rest") > 0, F.col("rest") / (F.col("source_size") - F.col("rest"))))
    plan = saved(plan, "mix-targets")
    # the bucket of random numbers in which each source's words run out; ranks rise with the number
    bucket = F.floor(F.col("_u") * BUCKETS)
    sums = df.groupBy("_s", bucket.alias("_b")).agg(F.sum("_n").alias("_words"))
    run = W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    sums = sums.withColumn("_sum", F.sum("_words").over(run))
    p = plan.select(F.col("_s").alias("_ps"), "rest", "odds")
    same = F.col("_s").eqNullSafe(F.col("_ps"))
    ends = sums.join(F.broadcast(p) if _few(plan) else p, same).where(F.col("_sum") > F.col("rest"))
    ends = ends.groupBy(F.col("_s").alias("_es")).agg(F.min(F.struct("_b", (F.col("_sum") - F.col("_words")).alias("before"))).alias("e"), F.first("rest").alias("rest"), F.first("odds").alias("odds"))
    ends = saved(ends.select("_es", F.col("e._b").alias("_eb"), F.col("e.before").alias("before"), "rest", "odds"), "mix-ends")
    few = _few(plan)
    edge = df.join(F.broadcast(ends) if few else ends, F.col("_s").eqNullSafe(F.col("_es")))
    rank = (F.col("_u") / (1 - F.col("_u"))) / F.col("odds")
    last = edge.where(bucket == F.col("_eb")).groupBy("_s", rank.alias("_q"), F.col("_id")).agg(F.sum("_n").alias("_n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    run = W.partitionBy("_s").orderBy("_q", "_id").rowsBetween(W.unboundedPreceding, 0)
    last = last.withColumn("_sum", F.col("before") + F.sum("_n").over(run))
    fits = F.col("_sum") <= F.col("rest")
    cut = last.groupBy(F.col("_s").alias("_cs")).agg(
        F.max(F.when(fits, F.struct("_q", "_id"))).alias("cut"),
        (F.first("rest") - F.coalesce(F.max(F.when(fits, F.col("_sum"))), F.first("before"))).alias("gap"),
    )
    cut = saved(cut, "mix-cuts")
    # of those not taken once more, the one whose size is nearest to what is missing
    left = edge.withColumn("_q", rank).join(F.broadcast(cut) if few else cut, F.col("_s").eqNullSafe(F.col("_cs")))
    left = left.where((bucket > F.col("_eb")) | ((bucket == F.col("_eb")) & (F.col("cut").isNull() | (F.struct("_q", "_id") > F.col("cut")))))
    left = left.groupBy("_s", "_q", "_id").agg(F.sum("_n").alias("_n"), F.first("gap").alias("gap"))
    off = F.abs(F.col("gap") - F.col("_n"))
    fill = left.where(off < F.col("gap")).groupBy(F.col("_s").alias("_fs")).agg(F.min(F.struct(off.alias("off"), F.col("_q"), F.col("_id"))).alias("fill"))
    out = plan.join(ends.select("_es", "_eb"), plan["_s"].eqNullSafe(F.col("_es")), "left")
    out = out.join(cut, out["_s"].eqNullSafe(F.col("_cs")), "left").join(fill, out["_s"].eqNullSafe(F.col("_fs")), "left")
    out = out.select("_s", "source_size", "target", "whole", "odds", "_eb", "cut", F.struct(F.col("fill._q"), F.col("fill._id")).alias("fill"), F.col("fill").isNotNull().alias("filled"))
    return saved(out, "mix-plan")


def _few(plan: DataFrame) -> bool:
    return plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


def mix(df: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` (how often the mix takes the row)."""
    df = without(df, "source_size", "target", "copies")
    u, p = fresh(df, "_u", "_plan")
    own = plan.select(F.struct(*plan.columns).alias(p))
    df = df.withColumn(u, _draw(id_col, seed)).join(F.broadcast(own) if _few(plan) else own, F.col(f"`{source_col}`").eqNullSafe(F.col(p)["_s"]), "left")
    of = lambda name: F.col(p)[name]
    key = F.struct(((F.col(u) / (1 - F.col(u))) / of("odds")).alias("_q"), F.col(f"`{id_col}`").alias("_id"))
    bucket = F.floor(F.col(u) * BUCKETS)
    once = F.when(of("odds").isNull(), False).when(of("_eb").isNull() | (bucket < of("_eb")), True).when(of("filled") & (key.eqNullSafe(of("fill"))), True).when((bucket > of("_eb")) | of("cut").isNull(), False).otherwise(key <= of("cut"))
    df = df.withColumns({"source_size": of("source_size"), "target": of("target"), "copies": of("whole") + once.cast("long")})
    return df.drop(u, p)


def mixed_rows(df: DataFrame, **how) -> DataFrame:
    """The rows of the mix itself: each row as often as it is taken, with the columns of ``df``."""
    by = {k: how[k] for k in ("id_col", "source_col", "seed") if k in how}
    text = how.pop("text_col", "text")
    key, source = by.get("id_col", "doc_id"), by.get("source_col", "source")
    sized = saved(df.select(F.col(f"`{key}`"), F.col(f"`{source}`"), n_words(F.col(f"`{text}`")).alias("size")), "mix-sizes")
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    at = lambda c: f"c{df.columns.index(c)}"
    out = mix(named, plan_mix(sized, **how), **(by | {"id_col": at(key), "source_col": at(source)}))
    out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*named.columns).toDF(*df.columns)
