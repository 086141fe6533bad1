"""Lookup of many addresses at once over two sources of deals.

An address query is a set of tokens, all of which an address must hold: numbers as whole numbers,
words as parts of words. Addresses are indexed by whole numbers and by the grams of their words,
up to three characters; a query meets only the addresses under its rarest entry, where all of its
tokens are checked. So no query scans the table, and no entry that most addresses share is read
unless a query has nothing rarer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clean import ADDRESS_STOP, cased_address, num, price_ils
from ..functions.schema import UNKNOWN
from ..sources.stage import staged
from .postings import asked_entries, candidates, part_entries

#: Characters of a query, years and floors it may name, properties it may find.
LEAST_CHARS, MOST_CHARS, YEARS, FLOORS, MOST_UNITS = 2, 160, (1900, 2100), (-10, 200), 50
#: Years of a query that names none, and what a confirmed pair may differ by.
FIRST_YEAR, LAST_YEAR, PRICE_M, AREA, ROOMS = 1998, 2026, 0.001000001, 0.5, 0.001
NUMBER, RUN = r"\p{Nd}+", r"[\p{L}\p{N}]+"


def query_tokens(cased: Column, stop: tuple[str, ...] = ADDRESS_STOP) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(cased, F.lit(RUN), F.lit(0))), lambda t: ~t.isin(*stop))


def _is_number(t: Column) -> Column:
    return F.regexp_like(t, F.lit(rf"^{NUMBER}$"))


def index_entries(cased: Column) -> Column:
    """The entries of an address: ``#`` and each whole number, and each part of a word of up to three characters."""
    numbers = F.transform(F.regexp_extract_all(cased, F.lit(NUMBER), F.lit(0)), lambda t: F.concat(F.lit("#"), t))
    return F.array_distinct(F.concat(numbers, F.flatten(F.transform(F.regexp_extract_all(cased, F.lit(RUN), F.lit(0)), part_entries))))


def token_entries(t: Column) -> Column:
    """The entries that every address with this token has."""
    return F.when(_is_number(t), F.array(F.concat(F.lit("#"), t))).otherwise(asked_entries(t))


def holds(cased: Column, tokens: Column) -> Column:
    """Whether a text holds every token; one without tokens is held by nothing."""
    numbers = F.regexp_extract_all(cased, F.lit(NUMBER), F.lit(0))
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.when(_is_number(t), F.array_contains(numbers, t)).otherwise(F.contains(cased, t)))


def match_addresses(addresses: DataFrame, queries: DataFrame, text: str = "full_address", keys: tuple[str, ...] = ("city",)) -> DataFrame:
    """``(query_id, *keys, text)``: the addresses that each query finds among those with its keys.

    ``addresses`` has the keys and the text, each pair once; ``queries`` (query_id, *keys, tokens).
    """
    asked = queries.select("query_id", *keys, "tokens", F.array_distinct(F.flatten(F.transform("tokens", token_entries))).alias("entries"))
    known = addresses.withColumn("cased", F.coalesce(cased_address(text), F.lit("")))
    met = candidates(known.select(*keys, text, "cased", index_entries(F.col("cased")).alias("entries")), asked, list(keys))
    return met.where(holds(F.col("cased"), F.col("tokens"))).select("query_id", *keys, text)


def read_queries(queries: DataFrame) -> DataFrame:
    """Queries with their tokens and, for those that cannot be asked, why (``refused``).

    ``queries`` has ``query_id``, ``city`` and ``address`` and may have ``floor``, ``year_from`` and ``year_to``.
    """
    have = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in queries.columns else F.lit(default)
    text = F.trim(F.coalesce("address", F.lit("")))
    floor = num("floor") if "floor" in queries.columns else F.lit(None).cast("double")
    out = queries.select(
        "query_id", "city", text.alias("address"), query_tokens(F.coalesce(cased_address(text), F.lit(""))).alias("tokens"), floor.alias("asked_floor"),
        have("year_from", FIRST_YEAR).alias("year_from"), have("year_to", LAST_YEAR).alias("year_to"),
    )
    chars = F.length("address")
    dull = F.col("city").isNull() | (chars < LEAST_CHARS) | (chars > MOST_CHARS) | (F.size("tokens") == 0)
    odd = ~F.col("year_from").between(YEARS[0], F.col("year_to")) | (F.col("year_to") > YEARS[1]) | ~F.coalesce(F.col("asked_floor").between(*FLOORS), F.lit(True))
    return out.withColumn("refused", F.when(dull, "no address").when(odd, "years or floor"))


def _plain(floor: Column) -> Column:
    return F.regexp_replace(floor.cast("string"), r"\.0$", "")


def _listed(values: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_set(values)), " / ")


FACTS = ("price_millions", "area", "rooms", "build_year")


def lookup_addresses(legacy: DataFrame, current: DataFrame, queries: DataFrame, key: str = "unit_key", most: int = MOST_UNITS) -> DataFrame:
    """Both sources' rows of the properties at each query's address, with how sure each link is.

    Legacy rows come by city, address and floor, with or without a property key; current rows by
    the keys of these, of which more than ``most`` refuse the query. A current full sale is
    ``confirmed`` by the legacy row found on its day if both are the only rows of their property and
    day among all rows of their source and their prices agree; it takes that row's place. Other
    current rows are ``candidate``, other legacy rows ``legacy``. ``conflicts`` names what differs
    in a confirmed pair, and properties whose legacy rows name several addresses or floors. A query
    that is refused has one row that says why.
    """
    asked = staged(read_queries(queries))
    able = asked.where("refused is null")
    text = F.coalesce(F.trim("full_address"), F.lit(""))
    matched = match_addresses(legacy.where(F.col("full_address").isNotNull()).select("city", "full_address").distinct(), able)
    own = ("record_id", "city", "deal_date", "floor", "full_address", *FACTS)
    rows = legacy.select(*own, (F.col("street") if "street" in legacy.columns else F.lit(None).cast("string")).alias("street"), F.col(key).alias("unit_key"))
    found = rows.join(matched, ["city", "full_address"]).join(able.select("query_id", "asked_floor", "year_from", "year_to"), "query_id")
    found = staged(found.where(F.col("asked_floor").isNull() | F.coalesce(num("floor") == F.col("asked_floor"), F.lit(False))))
    units = found.where("unit_key is not null").groupBy("query_id", "city", "unit_key").agg(
        _listed(F.nullif(text, F.lit(""))).alias("unit_address"), F.sort_array(F.collect_set(F.when(num("floor") != UNKNOWN, num("floor")))).alias("unit_floor"),
        _listed(F.nullif(F.trim("street"), F.lit(""))).alias("unit_street"), F.count("*").alias("unit_rows"),
    )
    units = staged(units)
    over = units.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("query_id")
    units = units.join(over, "query_id", "left_anti")
    places = units.select("city", "unit_key").distinct()
    unit, on = ["city", "unit_key"], ["city", "unit_key", "deal_date"]
    amount = F.col("deal_amount") if "deal_amount" in current.columns else F.lit(None).cast("double")
    cur = staged(current.select("record_id", "city", "deal_date", "sale_portion", amount.alias("deal_amount"), *FACTS, F.col(key).alias("unit_key")).join(places, unit, "left_semi"))
    old = staged(rows.join(places, unit, "left_semi"))
    # the only rows of their property and day in their source
    alone = lambda t, name: t.where("deal_date is not null").groupBy(*on).agg(F.count("*").alias("n"), F.min("record_id").alias(name)).where("n = 1").drop("n")
    a = cur.where(num("sale_portion") == 1).join(alone(cur, "_only").select(F.col("_only").alias("record_id")), "record_id", "left_semi")
    a = a.select(*on, F.col("record_id").alias("cid"), *[num(c).alias(f"n_{c}") for c in FACTS])
    b = old.join(alone(old, "_only").select(F.col("_only").alias("record_id")), "record_id", "left_semi").select(*on, F.col("record_id").alias("lid"), text.alias("day_address"), num("floor").alias("day_floor"), F.trim("street").alias("day_street"), *[num(c).alias(f"o_{c}") for c in FACTS])
    sure = a.join(b, on).where(F.abs(F.col("n_price_millions") - F.col("o_price_millions")) <= PRICE_M)
    differ = [F.when(F.coalesce(F.abs(F.col(f"n_{c}") - F.col(f"o_{c}")) > off, F.lit(True)), c) for c, off in (("area", AREA), ("rooms", ROOMS), ("build_year", 0.0))]
    sure = sure.select("cid", "lid", "day_address", F.when(F.col("day_floor") != UNKNOWN, F.col("day_floor")).alias("day_floor"), "day_street", *[f"o_{c}" for c in FACTS[1:]], F.array_compact(F.array(*differ)).alias("differ"))
    # a pair counts for the queries that found its legacy row
    sure = staged(found.join(over, "query_id", "left_anti").select("query_id", F.col("record_id").alias("lid")).join(sure, "lid"))
    names_many = lambda c: F.min(c) != F.max(c)
    mixed = old.groupBy(*unit).agg((names_many(text) | F.coalesce(names_many(num("floor")), F.lit(False))).alias("mixed"))
    out = cur.join(units.join(mixed, unit), unit).join(sure.withColumnRenamed("cid", "record_id"), ["query_id", "record_id"], "left")
    is_sure = F.col("lid").isNotNull()
    none = F.array().cast("array<string>")
    conflicts = F.array_join(F.concat(F.coalesce("differ", none), F.when(F.col("mixed"), F.array(F.lit("references"))).otherwise(none)), ",")
    pick = lambda day, unit_value: F.when(is_sure, day).otherwise(unit_value)
    out = out.select(
        "query_id", F.when(is_sure, "confirmed").otherwise("candidate").alias("status"), "record_id", *on, price_ils("deal_amount", "price_millions").alias("price_ils"), "sale_portion",
        *[num(c).alias(c) for c in FACTS[1:]], F.col("lid").alias("legacy_record_id"), *[F.col(f"o_{c}").alias(f"legacy_{c}") for c in FACTS[1:]],
        pick(F.col("day_address"), F.col("unit_address")).alias("reference_address"), pick(F.col("day_street"), F.col("unit_street")).alias("reference_streets"),
        pick(_plain(F.col("day_floor")), F.array_join(F.transform("unit_floor", _plain), " / ")).alias("reference_floor"), F.when(is_sure, 1).otherwise(F.col("unit_rows")).alias("references"),
        F.coalesce(F.nullif(conflicts, F.lit("")), F.when(is_sure, "none").otherwise("unchecked")).alias("conflicts"),
    )
    out = out.withColumn("reference_floor", F.coalesce("reference_floor", F.lit(""))).withColumn("reference_streets", F.coalesce("reference_streets", F.lit("")))
    nothing = lambda kind: F.lit(None).cast(kind)
    rest = found.join(over, "query_id", "left_anti").join(sure.select("query_id", F.col("lid").alias("record_id")), ["query_id", "record_id"], "left_anti").select(
        "query_id", F.lit("legacy").alias("status"), "record_id", *on, (num("price_millions") * 1e6).alias("price_ils"), nothing("double").alias("sale_portion"), *[num(c).alias(c) for c in FACTS[1:]],
        nothing("string").alias("legacy_record_id"), *[nothing("double").alias(f"legacy_{c}") for c in FACTS[1:]], text.alias("reference_address"),
        F.coalesce(F.trim("street"), F.lit("")).alias("reference_streets"), F.coalesce(_plain(num("floor")), F.lit("")).alias("reference_floor"), F.lit(1).cast("long").alias("references"), F.lit("share unknown").alias("conflicts"),
    )
    out = out.unionByName(rest).join(asked.select("query_id", "year_from", "year_to"), "query_id").where(F.year("deal_date").between(F.col("year_from"), F.col("year_to"))).drop("year_from", "year_to")
    no = asked.where("refused is not null").select("query_id", "city", F.col("refused").alias("conflicts"))
    no = no.unionByName(asked.join(over, "query_id", "left_semi").select("query_id", "city", F.lit("too many properties").alias("conflicts")))
    return out.unionByName(no.withColumn("status", F.lit("refused")), allowMissingColumns=True).withColumnRenamed("unit_key", key)


def lookup_address(legacy: DataFrame, current: DataFrame, query: str, key: str = "unit_key", city: str | None = None, floor: float | None = None, years: tuple[int, int] = (FIRST_YEAR, LAST_YEAR), most: int = MOST_UNITS) -> DataFrame:
    """``lookup_addresses`` of one address in one city, or in each city of the legacy source."""
    spark = legacy.sparkSession
    cities = legacy.select("city").distinct() if city is None else spark.createDataFrame([(city,)], "city string")
    asked = cities.select(F.concat_ws(":", F.lit("one"), "city").alias("query_id"), "city", F.lit(query).alias("address"), F.lit(floor).cast("double").alias("floor"), F.lit(years[0]).alias("year_from"), F.lit(years[1]).alias("year_to"))
    return lookup_addresses(legacy, current, asked, key, most)
