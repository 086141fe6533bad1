"""Linking two sources of deals, lookups, searches and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.clean import cadastral_key, cased_address, clean_text, num, price_ils, quality_flags, text_key
from ..functions.schema import UNKNOWN
from ..sources.stage import staged
from . import addresses
from .postings import find_parts

PRICE_M, AREA, ROOMS, PRICE_ILS = 0.001000001, 0.5, 0.001, 1000.0


def unique_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are complete and occur once; one grouping, so ``df`` is computed once. Select before what is needed."""
    rest = [c for c in df.columns if c not in keys]
    known = df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    return known.where("_n = 1").select(*keys, "_row.*")


def _agree(a: str, b: str, within: float, strict: bool = False) -> Column:
    x, y = num(a), num(b)
    gap = F.abs(x - y)
    return F.coalesce((x > 0) & (y > 0) & ((gap < within) if strict else (gap <= within)), F.lit(False))


FACTS = ["price_millions", "area", "rooms", "build_year"]


def strict_links(current: DataFrame, legacy: DataFrame) -> DataFrame:
    """``(city, _key, deal_date, record_id, legacy_record_id)`` of rows that are surely the same sale."""
    keys = ["city", "_key", "deal_date"]
    cur = current.withColumn("_key", cadastral_key("gush_code")).select(*keys, "record_id", "sale_portion", *FACTS)
    a = unique_by(cur, keys).where(num("sale_portion") == 1).select(*keys, "record_id", *[F.col(c).alias(f"n_{c}") for c in FACTS])
    b = _unique_legacy(legacy, [])
    return a.join(b, keys).where(_same_sale()).select(*keys, "record_id", F.col("o_record_id").alias("legacy_record_id"))


def _unique_legacy(legacy: DataFrame, more: list[str]) -> DataFrame:
    keys, got = ["city", "_key", "deal_date"], [*FACTS, *more, "record_id"]
    old = legacy.withColumn("_key", cadastral_key("gush_code"))
    return unique_by(old.select(*keys, *got), keys).select(*keys, *[F.col(c).alias(f"o_{c}") for c in got])


def _same_sale() -> Column:
    years = F.coalesce((num("n_build_year") > 0) & (num("o_build_year") > 0) & (num("n_build_year") != num("o_build_year")), F.lit(False))
    same = F.coalesce(F.abs(num("n_price_millions") - num("o_price_millions")) <= PRICE_M, F.lit(False))
    return same & _agree("n_area", "o_area", AREA) & _agree("n_rooms", "o_rooms", ROOMS, True) & ~years


def strict_enrich(current: DataFrame, legacy: DataFrame) -> DataFrame:
    """Current rows with place and floors of the one legacy row that is surely the same sale.

    The key is city, property and date, unique on both sides among all rows, whatever their kind.
    Adds ``street``, ``full_address``, ``floor``, ``build_floors``, ``legacy_record_id`` and ``legacy_match``.
    Rows of a key lie together and are counted there; those without one stand alone.
    """
    keys, places = ["city", "_key", "deal_date"], ["street", "full_address", "floor", "build_floors"]
    cur = current.drop(*[c for c in (*places, "legacy_record_id", "legacy_match") if c in current.columns]).withColumn("_key", cadastral_key("gush_code"))
    cur = cur.withColumn("_key", F.when(F.col("city").isNotNull() & F.col("deal_date").isNotNull(), F.col("_key"))).withColumn("_key", F.coalesce("_key", F.concat(F.lit("none:"), F.coalesce("record_id", F.lit("")))))
    cur = cur.withColumn("_alone", (F.count("*").over(W.partitionBy(*keys)) == 1) & F.coalesce(num("sale_portion") == 1, F.lit(False)))
    met = cur.withColumns({f"n_{c}": F.col(c) for c in FACTS}).join(_unique_legacy(legacy, places), keys, "left")
    met = met.withColumn("_good", F.col("_alone") & F.col("o_record_id").isNotNull() & _same_sale())
    known = lambda c: F.when(num(c) != UNKNOWN, num(c))
    said = {"street": clean_text("o_street"), "full_address": clean_text("o_full_address"), "floor": known("o_floor"), "build_floors": known("o_build_floors"), "legacy_record_id": F.col("o_record_id")}
    met = met.withColumns({c: F.when(F.col("_good"), v) for c, v in said.items()})
    first = [c for c in current.columns if c not in said and c != "legacy_match"]
    return met.select(*first, *said, F.when(F.col("legacy_record_id").isNotNull(), "strict_transaction").otherwise("unmatched").alias("legacy_match"))


def link_by_property(current: DataFrame, legacy: DataFrame, key: str = "unit_key") -> DataFrame:
    """Fill missing places and floors from legacy rows of a property that has one address and street.

    Expects the columns of ``strict_enrich``; keeps what was there as ``verified_*``.
    """
    floor = F.when(num("floor").between(-10, 200), num("floor"))
    old = legacy.where(F.col(key).isNotNull()).select("city", F.col(key).alias("_k"), clean_text("street").alias("s"), clean_text("full_address").alias("a"), floor.alias("f"), "record_id")
    ends = [f(c).alias(f"{c}{n}") for c in ("s", "a", "f") for n, f in (("", F.min), ("z", F.max))]
    ref = old.groupBy("city", "_k").agg(*ends, F.array_join(F.array_sort(F.collect_list("record_id")), ";").alias("ref"))
    ref = ref.where("a = az and s = sz and f <=> fz").select("city", F.col("_k").alias(key), "s", "a", "f", "ref")
    out = current.join(ref, ["city", key], "left")
    added = (F.col("street").isNull() & F.col("s").isNotNull()) | (F.col("full_address").isNull() & F.col("a").isNotNull()) | (F.col("floor").isNull() & F.col("f").isNotNull())
    out = out.withColumns({**{f"verified_{c}": F.col(c) for c in ("street", "full_address", "floor")}, "_added": F.coalesce(added, F.lit(False))})
    out = out.withColumns({
        "street": F.coalesce("street", "s"), "full_address": F.coalesce("full_address", "a"), "floor": F.coalesce("floor", "f"),
        "location_basis": F.when(F.col("_added"), "property_reference").otherwise(F.col("legacy_match")), "location_reference_id": F.when(F.col("_added"), F.col("ref")).otherwise(F.col("legacy_record_id")),
    })
    flags = quality_flags(missing_address="full_address", missing_floor="floor", missing_area="area", missing_rooms="rooms")
    return out.withColumn("quality_flags", F.concat_ws(";", F.nullif(flags, F.lit("")), F.when(F.col("_added"), "location_reference"))).drop("s", "a", "f", "ref", "_added")


def with_label(df: DataFrame, descriptions: DataFrame) -> DataFrame:
    """``gush_label``: the block's description, else its number."""
    d = descriptions.select("city", "gush", "gush_desc")
    return df.join(d, ["city", "gush"], "left").withColumn("gush_label", F.coalesce("gush_desc", F.col("gush").cast("long").cast("string"))).drop("gush_desc")


def cities_of(streets: DataFrame, gushes: list[float]) -> DataFrame:
    return streets.where(F.col("gush").isin(gushes)).select("city").distinct().orderBy("city")


def streets_of(streets: DataFrame, gushes: list[float]) -> DataFrame:
    return streets.where(F.col("gush").isin(gushes)).select("city", "street").distinct().orderBy("city", "street")


def gushes_of(streets: DataFrame, city: str, names: list[str] | None = None) -> DataFrame:
    found = streets.where(F.col("city") == city)
    return (found.where(F.col("street").isin(names)) if names else found).select("gush").distinct().orderBy("gush")


def search_gush(queries: DataFrame, descriptions: DataFrame, streets: DataFrame, limit: int = 25) -> DataFrame:
    """Blocks for each query: by number, label, city or street; a prefix before any other place.

    Queries meet distinct texts through their rarest part (``postings``), then the blocks of these.
    """
    q = queries.select("query", text_key("query").alias("q")).where("q <> ''").distinct()
    number = F.col("gush").cast("long").cast("string")
    own = descriptions.select("city", "gush", F.explode(F.array(number, text_key("gush_desc"), text_key("city"), text_key("street"))).alias("text"), F.lit(1).alias("other"))
    st = streets.select("city", "gush", text_key("street").alias("text"), F.lit(2).alias("other")).join(descriptions.select("city", "gush"), ["city", "gush"], "left_semi")
    places = staged(own.unionByName(st).where("text is not null").distinct())
    hits = find_parts(places, q.withColumnRenamed("query", "query_id"))
    rank = F.when(F.startswith("text", F.col("q")), 0).otherwise(F.col("other"))
    best = hits.join(places, "text").groupBy(F.col("query_id").alias("query"), "city", "gush").agg(F.min(rank).alias("rank"))
    w = W.partitionBy("query").orderBy("rank", "city", "gush")
    return with_label(best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit), descriptions)


def search_streets(queries: DataFrame, streets: DataFrame, descriptions: DataFrame, limit: int = 25) -> DataFrame:
    """For each query the streets that hold all of its tokens, each with its blocks and their labels.

    ``queries`` has a ``query`` per row; streets that start with it come first, then by city and name.
    """
    q = queries.select("query").distinct().select(F.col("query").alias("query_id"), addresses.query_tokens(F.coalesce(cased_address("query"), F.lit(""))).alias("tokens"))
    met = addresses.match_addresses(streets.select("street").where("street is not null").distinct(), q, "street", ())
    found = with_label(met.join(streets, "street"), descriptions)
    first = F.when(F.startswith(text_key("street"), text_key("query")), 0).otherwise(1)
    rows = found.withColumnRenamed("query_id", "query").groupBy("query", "city", "street").agg(F.sort_array(F.collect_set("gush")).alias("gush_ids"), F.sort_array(F.collect_set("gush_label")).alias("labels"), F.min(first).alias("rank"))
    w = W.partitionBy("query").orderBy("rank", "city", "street")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def search_street(streets: DataFrame, query: str, descriptions: DataFrame, limit: int = 25) -> DataFrame:
    """``search_streets`` of one query, in order."""
    one = streets.sparkSession.createDataFrame([(query,)], "query string")
    return search_streets(one, streets, descriptions, limit).orderBy("place").drop("query", "place")


def attach_polygons(descriptions: DataFrame, polygons: DataFrame, city: str, chosen: list[float], counts: DataFrame) -> DataFrame:
    """Polygons of a city's blocks and of the chosen ones: those labelled with the city if there are any."""
    asked = descriptions.where((F.col("city") == city) | F.col("gush").isin(chosen)).groupBy("gush").agg(F.min("gush_desc").alias("label"))
    local = text_key("poly_city") == city.lower()
    met = asked.join(polygons, "gush", "left").withColumn("_local", F.coalesce(local, F.lit(False)))
    met = met.withColumn("_r", F.rank().over(W.partitionBy("gush").orderBy(F.desc("_local")))).where("_r = 1").drop("_r", "_local")
    return met.join(counts, "gush", "left").withColumns({"deals": F.coalesce("deals", F.lit(0)), "selected": F.col("gush").isin(chosen), "missing": F.col("geometry").isNull()})


#: What tells a deal without a source key from another.
SIGNATURE = ["city", "street", "gush_code", "deal_date", "price_millions", "area", "rooms", "floor", "build_floors", "apt_type"]


def dedupe(df: DataFrame, seq: str = "seq") -> DataFrame:
    """The last row of each source key; rows without one only if no other row says the same."""
    last = lambda keys: F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(seq)))
    sourced, loose = df.where(F.col("source_key").isNotNull()), df.where(F.col("source_key").isNull())
    # of rows with a source key the signature alone goes to the others, once for all copies
    seen = sourced.select(*SIGNATURE).distinct().withColumn("_seen", F.lit(1))
    met = loose.withColumn("_seen", F.lit(0)).unionByName(seen, allowMissingColumns=True)
    alone = met.withColumns({"_other": F.max("_seen").over(W.partitionBy(*SIGNATURE)), "_r": F.row_number().over(W.partitionBy(*SIGNATURE).orderBy("_seen", F.desc(seq)))})
    alone = alone.where("_seen = 0 and _other = 0 and _r = 1").select(*df.columns)
    return sourced.withColumn("_r", last(["source_key"])).where("_r = 1").select(*df.columns).unionByName(alone)


#: So many pairs of a block and a city are sent to all tasks; beyond that rows are shuffled.
SENT_PAIRS = 100_000


def split_shared_gush(df: DataFrame, counted: bool = False) -> DataFrame:
    """A block number seen in several cities becomes ten times itself plus the city's place.

    ``counted``: the shared pairs of block and city are counted first, and sent to all tasks if they are few.
    """
    pairs = df.select("gush", "city").distinct()
    w = W.partitionBy("gush")
    many = pairs.withColumns({"_n": F.count("*").over(w), "_k": F.row_number().over(w.orderBy("city"))}).where("_n > 1").select("gush", "city", "_k")
    few = counted and many.limit(SENT_PAIRS + 1).count() <= SENT_PAIRS
    out = df.join(F.broadcast(many) if few else many, ["gush", "city"], "left")
    return out.withColumn("gush", F.when(F.col("_k").isNull(), F.col("gush")).otherwise(F.col("gush") * 10 + F.col("_k"))).drop("_k").select(*df.columns)


def _sources(current: DataFrame, legacy: DataFrame, columns: list) -> DataFrame:
    named = lambda df, name: df.select(*columns, F.lit(name).alias("source"))
    return named(current, "current").unionByName(named(legacy, "legacy"))


def with_partners(both: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Adds ``partners``: rows of the other ``source`` with equal keys and a ``price`` within the tolerance.

    Two stands for two or more; ``partner`` is the ``id`` where there is one. Of the rows on each side in
    order of price the two nearest of the other source tell that, so work is that of sorting and rows are
    shuffled by their keys alone, or not at all if they lie together already. Rows without a key or price
    have none.
    """
    known = F.col("price").isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    own = W.partitionBy(*keys, "source")
    here = F.struct("price", "id")
    sides, out = [], both
    for name, order in (("_below", ["price", "source", "id"]), ("_above", [F.desc("price"), F.desc("source"), F.desc("id")])):
        out = out.withColumn(f"{name}_own", F.array(here, F.lag(here).over(own.orderBy(*order))))
        upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        for s in ("current", "legacy"):
            out = out.withColumn(f"{name}_{s}", F.last(F.when(known & (F.col("source") == s), F.col(f"{name}_own")), ignorenulls=True).over(upto))
        sides.append(F.when(F.col("source") == "current", F.col(f"{name}_legacy")).otherwise(F.col(f"{name}_current")))
    none = F.array().cast("array<struct<price: double, id: string>>")
    found = F.filter(F.concat(*[F.coalesce(s, none) for s in sides]), lambda x: F.abs(x["price"] - F.col("price")) <= tolerance)
    out = out.withColumn("_found", F.when(known, found).otherwise(none))
    out = out.withColumns({"partners": F.least(F.size("_found"), F.lit(2)), "partner": F.when(F.size("_found") == 1, F.col("_found")[0]["id"])})
    return out.drop("_found", *[f"{n}_{s}" for n in ("_below", "_above") for s in ("own", "current", "legacy")])


def partners(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """``left`` (*keys, price, id) with the ``partners`` and ``partner`` that it has in ``right``."""
    return with_partners(_sources(left, right, [*keys, "price", "id"]), keys, tolerance).where("source = 'current'").drop("source")


def deal_history(current: DataFrame, legacy: DataFrame, key: str = "unit_key") -> DataFrame:
    """All records of each property from both sources, and what else there is on the same day.

    ``parallel_source`` tells whether the other source has a price within the tolerance on that day.
    The rows of a property lie together, so they are shuffled once.
    """
    both = _sources(current, legacy, ["record_id", "city", key, "deal_date", "price_millions"]).where(F.col(key).isNotNull()).repartition("city", key)
    priced = both.withColumns({"price": price_ils(F.lit(None).cast("double"), "price_millions"), "id": F.col("record_id")})
    unit, day = W.partitionBy("city", key), W.partitionBy("city", key, "deal_date")
    first = F.row_number().over(day.orderBy("source")) == 1
    out = with_partners(priced, ["city", key, "deal_date"], PRICE_ILS).withColumn("_first", first & F.col("deal_date").isNotNull())
    out = out.withColumns({"records": F.count("*").over(unit), "dates": F.count_if("_first").over(unit), "same_date": F.count("*").over(day) > 1, "parallel_source": F.col("partners") > 0})
    return out.select("record_id", "city", key, "deal_date", "price_millions", "source", "records", "dates", "same_date", "parallel_source")


def pair_parallel(current: DataFrame, legacy: DataFrame, key: str = "unit_key") -> DataFrame:
    """Pairs of a current full sale and a legacy row that have only each other on a day and price."""
    on = ["city", key, "deal_date"]
    columns = [*on, num("price_millions").alias("price"), F.col("record_id").alias("id")]
    both = _sources(current.where(num("sale_portion") == 1), legacy, columns).where(F.col(key).isNotNull() & F.col("deal_date").isNotNull() & F.col("price").isNotNull())
    one = with_partners(both.repartition(*on), on, PRICE_ILS / 1e6).where("partner is not null")
    said = lambda s: F.max(F.when(F.col("source") == s, F.col("price")))
    mine = F.col("source") == "current"
    one = one.withColumns({"current_id": F.when(mine, F.col("id")).otherwise(F.col("partner")), "legacy_id": F.when(mine, F.col("partner")).otherwise(F.col("id"))})
    pairs = one.groupBy(*on, "current_id", "legacy_id").agg(said("current").alias("price_millions"), said("legacy").alias("legacy_price"))
    return pairs.dropna(subset=["price_millions", "legacy_price"]).select(*on, "current_id", "price_millions", "legacy_id", "legacy_price")


def resolve_areas(descriptions: DataFrame, streets: DataFrame, ids: list[float] = (), labels: list[str] = (), city_streets: list[tuple[str, str]] = (), most: int = 15) -> DataFrame:
    """The chosen blocks of ids, exact labels and streets; more than ``most`` is an error."""
    by_id = descriptions.where(F.col("gush").isin(list(ids))).select("city", "gush")
    by_label = descriptions.where(F.col("gush_desc").isin(list(labels))).select("city", "gush")
    some = F.lit(False)
    for city, street in city_streets:
        some |= (F.col("city") == city) & (F.col("street") == street)
    out = by_id.unionByName(by_label).unionByName(streets.where(some).select("city", "gush")).distinct()
    if out.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} areas are chosen")
    return out


def by_date(history: DataFrame, key: str = "unit_key") -> DataFrame:
    """A history's days, the newest first, each with its records in order of source and id."""
    said = F.struct("source", "record_id", "price_millions", "parallel_source")
    g = history.groupBy("city", key, "deal_date").agg(F.sort_array(F.collect_list(said)).alias("list"))
    # the records of one property and day
    g = g.select("city", key, "deal_date", F.size("list").cast("long").alias("records"), F.array_join(F.array_distinct("list.source"), ",").alias("sources"), F.col("list"))
    return g.orderBy("city", key, F.desc("deal_date"))
