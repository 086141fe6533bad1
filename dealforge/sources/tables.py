"""Reading and writing of deals, lookups, raw files and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import clean
from ..functions.schema import DEALS
from . import files


def read_deals(spark: SparkSession, path: str, cities: list[str] | None = None) -> DataFrame:
    """Deals partitioned by city; only the asked cities are opened.

    ``record_id`` is the row's source id, or ``legacy:<city>:<row>`` by its place among the city's rows.
    """
    df = spark.read.parquet(path)
    if cities:
        df = df.where(F.col("city").isin(sorted(set(cities))))
    own = F.col("source_id") if "source_id" in df.columns else F.lit(None).cast("string")
    if "record_id" not in df.columns:
        df = files.with_row_numbers(df, "city")
        df = df.withColumn("record_id", F.coalesce(own, F.concat_ws(":", F.lit("legacy"), "city", F.col("_row").cast("string")))).drop("_row")
    for f in DEALS:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_types(spark: SparkSession, path: str) -> DataFrame:
    """The values of a JSON array of names, or of the arrays in a JSON object."""
    raw = spark.read.text(path, wholetext=True)
    names = F.coalesce(F.from_json("value", "array<string>"), F.flatten(F.map_values(F.from_json("value", "map<string,array<string>>"))))
    return raw.select(F.explode(names).alias("apt_type")).distinct()


POLYGONS = "type string, features array<struct<type:string,properties:struct<GUSH_NUM:double,LOCALITY_N:string,REG_MUN_NA:string,FID:long>,geometry:string>>"


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """``(gush, poly_city, feature_id, geometry)`` of a GeoJSON collection; another type raises."""
    raw = spark.read.schema(POLYGONS).option("multiLine", True).json(path)
    ok = F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(F.raise_error(F.concat(F.lit("not a feature collection: "), F.coalesce("type", F.lit("no type")))))
    p = raw.select(F.explode(ok).alias("f"))
    return p.select(F.col("f.properties.GUSH_NUM").alias("gush"), F.coalesce("f.properties.LOCALITY_N", "f.properties.REG_MUN_NA").alias("poly_city"), F.col("f.properties.FID").alias("feature_id"), F.col("f.geometry").alias("geometry"))


def read_index(spark: SparkSession, path: str, year: str = "Year", value: str = "index_shekels") -> DataFrame:
    """``(year, index_value)`` of a CSV; incomplete rows are dropped."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(clean.num(year).cast("int").alias("year"), clean.num(value).alias("index_value")).dropna()


def read_raw_csv(spark: SparkSession, paths: list[str], resources: dict[str, str] | None = None) -> DataFrame:
    """CSV files as texts, only the empty text null, with each row's file and resource."""
    df = spark.read.option("header", True).option("inferSchema", False).option("nullValue", "").option("emptyValue", "").csv(paths)
    df = df.withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1))
    return df.withColumn("resource_id", clean.city_name("source_file", resources or {}))


def read_snapshot(spark: SparkSession, versions: list[dict], root: str) -> DataFrame:
    """The rows of the highest version's files, with version, file and line; the header is line 1."""
    latest = max(versions, key=lambda v: v["version_number"])
    df = files.with_line_numbers(read_raw_csv(spark, [f"{root}/{name}" for name in latest["files"]]))
    return df.withColumns({"source_version": F.lit(latest["version_number"]), "source_id": F.concat_ws(":", "source_file", F.col("source_row").cast("string"))})


def check_files(spark: SparkSession, root: str, inventory: DataFrame, whole: int | None = None) -> DataFrame:
    """The files of an inventory ``(file, sha256, rows)`` that are missing or differ, and how; ``whole`` as in ``files.digests``."""
    met = inventory.join(files.digests(spark, root, whole), "file", "left")
    wrong = F.when(F.col("got_sha256").isNull(), "missing").when(F.col("got_sha256") != F.col("sha256"), "checksum").when(F.coalesce("got_rows", F.lit(0)) != F.col("rows"), "rows")
    return met.withColumn("problem", wrong).where("problem is not null")


def one_settlement_per_file(raw: DataFrame) -> DataFrame:
    """The files that name more than one settlement."""
    return raw.groupBy("source_file").agg(F.countDistinct("settlement_code").alias("settlements")).where("settlements > 1")


def write_deals(df: DataFrame, path: str) -> None:
    """One folder of zstd Parquet per city; an existing output is refused."""
    df.repartition("city").write.mode("errorifexists").option("compression", "zstd").partitionBy("city").parquet(path)


def check_roundtrip(before: DataFrame, after: DataFrame, by: str = "city") -> DataFrame:
    """Per group: rows and ends of dates on both sides, rows that only one side has, and whether all agree."""
    side = lambda df, p: df.groupBy(by).agg(F.count("*").alias(f"{p}_rows"), F.min("deal_date").alias(f"{p}_first"), F.max("deal_date").alias(f"{p}_last"))
    # rows are compared by their SHA-256, which is what is shuffled: once for both sides, each row as often as it occurs
    said = F.unhex(F.sha2(F.to_json(F.struct(*sorted(before.columns)), {"ignoreNullFields": "false"}), 256)).alias("_row")
    count = lambda df, n: df.select(by, said, F.lit(n).alias("_n"))
    gap = count(before, 1).unionByName(count(after, -1)).groupBy(by, "_row").agg(F.sum("_n").alias("_n")).where("_n <> 0")
    gaps = gap.groupBy(by).agg(F.coalesce(F.sum(F.when(F.col("_n") > 0, F.col("_n"))), F.lit(0)).alias("lost"), F.coalesce(F.sum(F.when(F.col("_n") < 0, -F.col("_n"))), F.lit(0)).alias("extra"))
    out = side(before, "before").join(side(after, "after"), by, "full").join(gaps, by, "left").na.fill(0, ["lost", "extra"])
    same = F.col("before_rows").eqNullSafe(F.col("after_rows")) & F.col("before_first").eqNullSafe(F.col("after_first")) & F.col("before_last").eqNullSafe(F.col("after_last"))
    return out.withColumn("same", same & (F.col("lost") == 0) & (F.col("extra") == 0))


def publish(df: DataFrame, coverage: DataFrame, path: str, **more: DataFrame) -> None:
    """Deals and further tables first, the coverage that makes them visible last; all or nothing."""
    files.publish_all({"cities": df, **more, "coverage": coverage}, path, "coverage", {"cities": "city"})


def build_descriptions(df: DataFrame, pick: str = "most_deals") -> DataFrame:
    """Per block the street with most deals, how many, and ``city gush (street and k other streets)``."""
    if pick not in ("most_deals", "first_street"):
        raise ValueError(f"no such pick: {pick}")
    g = df.where("city is not null and gush is not null and street is not null").groupBy("city", "gush", "street").agg(F.count("*").alias("n"))
    w = W.partitionBy("city", "gush")
    order = [F.desc("n"), "street"] if pick == "most_deals" else ["street"]
    top = g.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "_k": F.count("*").over(w) - 1}).where("_r = 1")
    others = F.when(F.col("_k") > 0, F.concat(F.lit(" and "), F.col("_k").cast("string"), F.lit(" other streets"))).otherwise("")
    label = F.concat("city", F.lit(" "), F.col("gush").cast("long").cast("string"), F.lit(" ("), "street", others, F.lit(")"))
    return top.select("city", "gush", "street", "n", label.alias("gush_desc"))


def build_streets(df: DataFrame) -> DataFrame:
    return df.where("street is not null and gush is not null").select("city", "gush", "street").distinct()


def build_types(df: DataFrame) -> DataFrame:
    return df.where("apt_type is not null").select("apt_type").distinct().orderBy("apt_type")


#: English headers of an export's first columns, in order.
EXPORT = {
    "record_id": "Record", "city": "City", "street": "Street", "full_address": "Address", "gush": "Gush", "gush_code": "Gush code", "deal_date": "Date", "price_millions": "Price (millions)",
    "area": "Area", "rooms": "Rooms", "floor": "Floor", "apt_type": "Type", "roof": "Roof",
}


#: Headers of downloaded deals and of downloaded summaries, in order.
RAW_HEADERS = {
    "city": "City", "street": "Street", "gush": "Gush", "gush_code": "Gush Code", "full_address": "Full Address", "deal_date": "Date", "deal_year": "Deal Year",
    "price_millions": "Price Millions", "price_per_m2": "Price Per M2", "price_per_room": "Price Per Room", "area": "Area", "rooms": "Rooms", "floor": "Floor", "roof": "Roof",
    "apt_type": "Apartment Type", "new_project": "New Project", "build_year": "Build Year", "building_age": "Building Age", "build_floors": "Building Floors", "story": "Story",
}
SUMMARY_HEADERS = {
    "city": "City", "gush": "Gush", "gush_label": "Gush Label", "deal_year": "Deal Year", "n_deals": "Deals", "price_millions": "Price Millions", "price_per_m2": "Price Per M2",
    "price_per_room": "Price Per Room", "y": "Selected Value", "performance_group": "Performance Group", "rank": "Rank", "position_in_group": "Position In Group",
    "price_change": "Price Change %", "annualized_change": "Annualized Change % (CAGR)", "first_deals": "First Year Deals", "last_deals": "Last Year Deals", "first_year": "First Year",
    "last_year": "Last Year", "first_y": "First Selected Value", "last_y": "Last Selected Value", "median_deals": "Median Deals Per Year", "total_deals": "Total Deals",
}


def export_columns(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """The export's columns first under their headers, then all others under their own names."""
    names = names or EXPORT
    first = [c for c in names if c in df.columns]
    return df.select(*[F.col(c).alias(names[c]) for c in first], *[c for c in df.columns if c not in first])


def write_export(df: DataFrame, path: str, names: dict[str, str] | None = None, single: bool = False) -> None:
    out = export_columns(df, names)
    (out.coalesce(1) if single else out).write.mode("errorifexists").option("header", True).csv(path)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    getattr(df.write.mode("errorifexists").option("header", True) if kind == "csv" else df.write.mode("errorifexists"), kind)(path)


def append_existing(new: DataFrame, old: DataFrame) -> DataFrame:
    """New rows and the existing ones, by column name; existing rows have no source key."""
    return new.unionByName(old.drop("source_key").withColumn("source_key", F.lit(None).cast("string")), allowMissingColumns=True)


#: Types of roof apartments and the word for a roof.
ROOF_TYPES, ROOF_WORD = ["דירת גג", "דירת גג (פנטהאוז)", "מיני פנטהאוז"], "גג"


def transform_raw(df: DataFrame, aliases: dict[str, str] | None = None, floors: dict[str, float] | None = None, phrases: dict[str, float] | None = None) -> DataFrame:
    """Raw texts of the first source as deals; rows with a city and a date stay."""
    floors = clean.floor_words() if floors is None else floors
    phrases = clean.HIGH_FLOORS if phrases is None else phrases
    base = df.select(
        "*", clean.city_name("city_name", aliases or {}).alias("city"), F.coalesce(clean.parse_date(F.substring("dealdatetime", 1, 10), "yyyy-MM-dd"), clean.parse_date("dealdate", "dd.MM.yyyy")).alias("deal_date"),
        clean.parse_number("dealamount").alias("_amount"), clean.parse_number("dealnature").alias("area"), clean.parse_number("assetroomno").alias("rooms"), clean.floor_number("floorno", floors).alias("floor"),
        clean.parse_number("buildingfloors").alias("build_floors"), clean.parse_number("buildingyear").alias("build_year"), clean.parse_number("yearbuilt").alias("_built"), clean.clean_text("dealnaturedescription").alias("apt_type"),
    )
    d = base.withColumns({"deal_year": F.year("deal_date").cast("double"), "_high": clean.high_floor("floorno", phrases, "floor"), "_street": clean.clean_text("street")})
    out = d.select(
        clean.source_key("resource_id", "row_num").alias("source_key"), "city", F.col("_street").alias("street"), clean.gush_of("gush").alias("gush"), clean.clean_text("gush").alias("gush_code"),
        F.coalesce(clean.clean_text("fulladdress"), clean.clean_text("displayaddress"), clean.address_of("_street", "city")).alias("full_address"), "deal_date", "deal_year", (F.col("_amount") / 1e6).alias("price_millions"),
        "area", "rooms", "floor", "build_floors", clean.roof_flag("apt_type", "floorno", "floor", "_high", "build_floors", ROOF_TYPES, ROOF_WORD).cast("string").alias("roof"), "apt_type",
        clean.new_project_flag("newprojectext", "build_year", "deal_year").alias("new_project"), F.coalesce("build_year", "_built").alias("build_year"), clean.building_age("deal_year", "build_year", "_built").alias("building_age"),
        clean.story(year="deal_year", date="dealdate", address="fulladdress", type="apt_type", key="gush", built="build_year", floor="floorno", rooms="rooms", area="area", amount="dealamount", per_m2=F.bround(F.try_divide(F.col("_amount"), F.col("area")), 0)).alias("story"),
    )
    return out.where("city is not null and deal_date is not null")


def transform_raw2(df: DataFrame) -> DataFrame:
    """Raw texts of the second source as deals with lineage and no place yet."""
    more = lambda c: F.when(clean.num(c) > 0, clean.num(c))
    d = df.withColumn("deal_date", clean.parse_date("deal_date", "dd/MM/yyyy"))
    code = F.concat_ws("-", F.coalesce("gush", F.lit("")), F.coalesce("chelka", F.lit("")), F.coalesce("sub_chelka", F.lit("")))
    d = d.withColumns({"deal_year": F.year("deal_date").cast("double"), "build_year": more("year_built"), "amount": clean.num("deal_amount")})
    return d.select(
        F.col("source_id").alias("record_id"), F.col("settlement").alias("city"), clean.cadastral_key(code).alias("gush_code"), clean.num("gush").alias("gush"), "deal_date", "deal_year", F.col("amount").alias("deal_amount"),
        clean.num("declared_amount").alias("declared_amount"), clean.num("portion").alias("sale_portion"), (F.col("amount") / 1e6).alias("price_millions"), more("asset_area").alias("area"), more("room_num").alias("rooms"), "build_year",
        clean.building_age("deal_year", "build_year").alias("building_age"), F.col("deal_nature").alias("apt_type"), "settlement_code", F.try_to_timestamp("scraped_at").alias("scraped_at"), "source_version", "source_file", "source_row", "source_id",
    )
