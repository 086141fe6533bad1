"""Hand-made frames with known results."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from dealforge.functions import clean, filters
from dealforge.functions.filters import FilterSpec
from dealforge.operators import addresses, growth, linkage, outliers, quality, quantiles, segments, summary
from dealforge.sources import tables

DAY = datetime.date(2020, 5, 1)


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_price_metrics_and_plausible_area(spark):
    df = rows(spark, [(2.0, 100.0, 4.0), (2.0, 10.0, 1.0), (2.0, 30.0, 5.0), (2.0, 100.0, 999.0), (None, 100.0, 4.0)], "price_millions double, area double, rooms double")
    got = df.select(*[clean.price_metric(k).alias(k) for k in summary.KINDS]).collect()
    assert tuple(got[0]) == (2.0, 20.0, 0.5)
    assert got[1]["per_m2"] is None and got[2]["per_m2"] is None
    assert got[3]["per_room"] is None and got[4]["price"] is None


def test_num_drops_what_is_no_finite_number(spark):
    df = rows(spark, [("1.5",), ("NaN",), ("Infinity",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(clean.num("v")).collect()] == [1.5, None, None, None, None]


def test_texts_and_keys(spark):
    df = rows(spark, [("₪1,234.5 x", " 31.12.2020", "007-1-02", "קומה 3", "TRUE", "תל-אביב יפו")], "n string, d string, k string, f string, r string, p string")
    got = df.select(clean.parse_number("n"), clean.parse_date(F.trim("d")), clean.cadastral_key("k"), clean.floor_number("f", clean.floor_words()), clean.tri_state("r"), clean.place_key("p")).first()
    assert tuple(got) == (1234.5, datetime.date(2020, 12, 31), "7-1-2", 3.0, True, "תלאביביפו")
    words = clean.floor_words()
    assert len(words) == 133 and len(clean.HIGH_FLOORS) == 57
    floors = rows(spark, [("קרקע + ראשונה", 4.0), ("שביעית שמינית", 8.0), ("שלישית", 9.0), (" ד' ", 5.0), ("שלושים ושבע", 1.0)], "f string, top double")
    floors = floors.withColumns({"low": clean.floor_number("f", words)}).withColumn("high", clean.high_floor("f", clean.HIGH_FLOORS, "low"))
    assert [tuple(r) for r in floors.select("low", "high", clean.roof_flag("f", "f", "low", "high", "top", tables.ROOF_TYPES, tables.ROOF_WORD)).collect()] == [(0.0, 1.0, False), (7.0, 8.0, True), (3.0, 3.0, False), (4.0, 4.0, False), (37.0, 37.0, False)]
    assert words["שניה"] == 2 and words["שתים עשרה"] == 12 and words["עשרים ושלוש"] == 23 and words["קרקע"] == 0
    bad = rows(spark, [("0-1-2",), ("1-2",), ("a-1-2",), (None,), ("1-2-0",)], "k string")
    assert {r[0] for r in bad.select(clean.cadastral_key("k")).collect()} == {None}


def test_unknown_values_stay_unless_switched_off(spark):
    df = rows(spark, [(1, 2.0, 2.25), (2, 999.0, 999.0), (3, None, None), (4, 8.0, 4.0)], "id int, floor double, rooms double")
    ids = lambda c: sorted(r[0] for r in df.where(c).select("id").collect())
    assert ids(filters.floor_ok((0, 5))) == [1, 2, 3]
    assert ids(filters.floor_ok((0, 5), False)) == [1]
    assert ids(filters.floor_ok(None, False)) == [1, 4]
    assert ids(filters.rooms_ok([2.0])) == [1, 2, 3]  # 2.25 rounds to the even half
    assert filters.floor_ok(None) is None
    with pytest.raises(ValueError):
        filters.roof_ok("maybe")


def test_address_tokens(spark):
    df = rows(spark, [("Herzl 12, Town",), ("Herzl 120, Town",), (None,)], "full_address string")
    assert df.where(filters.address_ok("town 12")).count() == 1
    assert df.where(filters.address_ok(" , ")).count() == 0
    wide = rows(spark, [("Ｈｅｒｚｌ １２, Town",), ("ﬁeld ½ 7",), ("רח׳ ה\u05b6רצל 12",), ("a\u05be12",), (None,)], "full_address string")
    count = lambda q: wide.where(filters.address_ok(q)).count()
    assert [count("herzl 12"), count("field 7"), count("הרצל 12"), count("“herzl” 12"), count("12"), count("רחוב")] == [1, 1, 1, 1, 3, 0]
    with pytest.raises(ValueError):
        filters.address_ok("x" * 161)


def test_full_sales_by_default(spark):
    df = rows(spark, [("a", 1.0), ("b", 0.5), ("c", None)], "record_id string, sale_portion double").withColumns({c: F.lit(None).cast("double") for c in ("price_millions", "area", "rooms")})
    assert filters.apply_filters(df, FilterSpec()).count() == 1
    assert filters.apply_filters(df, FilterSpec(share="unknown")).count() == 1
    assert filters.apply_filters(df, FilterSpec(share="all")).count() == 3


def test_trimming(spark):
    area = rows(spark, [(10.0,), (11.0,), (12.0,), (1000.0,)], "area double")
    assert sorted(r[0] for r in outliers.trim_var(area).collect()) == [10, 11, 12]
    data = [(2020.0, v) for v in (1.0, 1.1, 1.2, 50.0)] + [(2021.0, 1.0 + i / 10) for i in range(10)]
    df = rows(spark, data, "deal_year double, price_millions double")
    kept = [r["price_millions"] for r in outliers.trim_by_year(df).collect()]
    assert len(kept) == 13 and max(kept) < 2
    odd = df.unionByName(rows(spark, [(None, 900.0), (2020.0, None)], "deal_year double, price_millions double"))
    assert outliers.trim_by_year(odd).count() == 15
    assert outliers.trim_by_year(df.limit(0)).count() == 0


def test_annual_profile_and_histogram(spark):
    df = rows(spark, [(2020.0, 2.0), (2020.0, 3.0), (2022.0, 5.0), (None, 4.0), (2022.0, None)], "deal_year double, price_millions double").withColumns({"area": F.lit(100.0), "rooms": F.lit(3.0)})
    got = {r["year"]: (r["deals"], r["valid_prices"], r["median"]) for r in summary.annual_profile(df).collect()}
    assert got == {2020: (2, 2, 2.5), 2021: (0, 0, None), 2022: (2, 1, 5.0)}
    h = summary.histogram(df, F.col("price_millions")).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 2] and h[-1]["high"] == 5.0
    assert [r["count"] for r in summary.histogram(df, F.lit(1.0)).collect()] == [5]


def test_smart_rooms(spark):
    df = rows(spark, [(float(r),) for r, n in ((2, 10), (3, 50), (4, 30), (5, 9), (6, 1)) for _ in range(n)], "rooms double")
    assert sorted(r["room"] for r in summary.smart_rooms(df).collect()) == [2, 3, 4, 5] or sorted(r["room"] for r in summary.smart_rooms(df).collect()) == [2, 3, 4]


def test_growth_and_performers(spark):
    data = [("a", y, 10, v) for y, v in ((2000.0, 1.0), (2001.0, 2.0), (2002.0, 4.0))] + [("b", y, 10, v) for y, v in ((2000.0, 1.0), (2002.0, 1.21))] + [("c", 2000.0, 2, 1.0), ("c", 2002.0, 10, 9.0)]
    s = rows(spark, data, "place string, deal_year double, n_deals long, y double")
    p = growth.comparison_period(s, 2003)
    g = growth.growth(s, p, 5, ("place",)).orderBy("rank").collect()
    assert [(r["place"], r["annualized_change"]) for r in g] == [("a", 100.0), ("b", 10.0)]
    picks = growth.pick_performers(growth.growth(s, p, 5, ("place",)), 1, 1, 1).collect()
    assert {(r["place"], r["performance_group"]) for r in picks} == {("a", "top"), ("b", "bottom")}
    yoy = {(r["place"], r["to_year"]): r["yoy_pct_change"] for r in growth.yoy(s, ["place"]).collect()}
    assert yoy["b", 2002.0] == 10.0 and yoy["a", 2000.0] is None


def test_city_ranking_needs_two_shared_years(spark):
    data = [("A", 2019.0, 5, 9.0), ("A", 2020.0, 5, 10.0), ("A", 2022.0, 5, 11.0), ("B", 2020.0, 5, 10.0), ("B", 2022.0, 5, 15.0)]
    s = rows(spark, data, "city string, deal_year double, n_deals long, y double")
    got = growth.rank_cities(s).collect()
    assert [(r["city"], r["pct_change"], r["first_year"]) for r in got] == [("B", 50.0, 2020.0), ("A", 10.0, 2020.0)]
    none = s.unionByName(rows(spark, [("C", 2020.0, 5, None)], s.schema))
    assert growth.rank_cities(none).count() == 0
    rel = {(r["city"], r["deal_year"]): r["y"] for r in growth.relative_series(s, "city").collect()}
    assert rel["A", 2022.0] == 110.0 and ("A", 2019.0) not in rel


def test_hedonic_index_recovers_growth(spark):
    rnd = random.Random(7)
    data = []
    for year, mix in ((2020, 0.2), (2021, 0.5), (2022, 0.8)):
        for _ in range(200):
            area = 120.0 if rnd.random() < mix else 60.0
            price = 1.1 ** (year - 2020) * 0.03 * area**0.8 * math.exp(rnd.gauss(0, 0.02))
            data.append((float(year), price, area, 4.0 if area > 100 else 2.0, 3.0, 10.0, "flat"))
    df = rows(spark, data, "deal_year double, price_millions double, area double, rooms double, floor double, building_age double, apt_type string")
    got = {r["year"]: r for r in segments.hedonic_index(df).collect()}
    assert abs(got[2022]["adjusted"] - 121) < 1.5 and got[2020]["adjusted"] == 100
    assert segments.hedonic_index(df.limit(5)).count() == 0


def test_nice_breaks(spark):
    df = rows(spark, [(float(x),) for x in range(61, 110)], "area double")
    assert segments.nice_breaks(df, "area", 5, 8) == [60, 70, 80, 90, 100, 110]
    far = df.unionByName(rows(spark, [(2900.0,)], "area double"))
    breaks = segments.nice_breaks(far, "area", 5, 8)
    assert breaks == [60, 80, 100, 120, 2500, 3000]
    assert segments.nice_breaks(rows(spark, [(float(x),) for x in range(11)], "area double"), "area", 5, 8) == [0, 2.5, 5, 7.5, 10, 12.5]
    assert segments.nice_breaks(rows(spark, [(7.0,)] * 3, "area double"), "area", 5, 8) == [7, 8]
    few = rows(spark, [(float(x),) for x in (1, 2, 3, 900)], "area double")
    assert segments.nice_breaks(few, "area", 3, 8) == [0, 250, 500, 750, 1000]


CUR = "record_id string, city string, gush_code string, unit_key string, deal_date date, price_millions double, area double, rooms double, build_year double, sale_portion double"
OLD = "record_id string, city string, gush_code string, unit_key string, deal_date date, price_millions double, area double, rooms double, build_year double, street string, full_address string, floor double, build_floors double"


@pytest.mark.parametrize(("change", "match"), [({}, True), ({"price_millions": 2.01}, False), ({"area": 81.0}, False), ({"rooms": 3.5}, False), ({"build_year": 1999.0}, False), ({"build_year": 0.0}, True), ({"sale_portion": 0.5}, False), ({"gush_code": "1-2-0"}, False)])
def test_strict_enrich(spark, change, match):
    base = {"record_id": "n", "city": "X", "gush_code": "1-2-3", "unit_key": "1-2-3", "deal_date": DAY, "price_millions": 2.0, "area": 80.0, "rooms": 3.0, "build_year": 2000.0, "sale_portion": 1.0}
    cur = rows(spark, [tuple((base | change).values())], CUR)
    old = rows(spark, [("o", "X", "01-2-3", "1-2-3", DAY, 2.0005, 80.4, 3.0, 2000.0, " S ", "S 1", 999.0, 4.0)], OLD)
    got = linkage.strict_enrich(cur, old).first()
    assert (got["legacy_match"] == "strict_transaction") is match
    if match:
        assert (got["street"], got["floor"], got["build_floors"], got["legacy_record_id"]) == ("S", None, 4.0, "o")
    assert linkage.strict_enrich(cur, old.unionByName(old)).first()["legacy_match"] == "unmatched"


def test_link_by_property(spark):
    cur = rows(spark, [("n", "X", "1-2-3", "1-2-3", DAY, 2.0, 80.0, 3.0, 2000.0, 1.0)], CUR).withColumns({c: F.lit(None).cast("string") for c in ("street", "full_address", "legacy_record_id")} | {"floor": F.lit(None).cast("double"), "legacy_match": F.lit("unmatched")})
    old = rows(spark, [("o", "X", "1-2-3", "1-2-3", DAY, 1.0, 80.0, 3.0, None, "S", "S 1", 2.0, 4.0)], OLD)
    got = linkage.link_by_property(cur, old).first()
    assert (got["street"], got["floor"], got["location_basis"], got["location_reference_id"], got["verified_street"], got["quality_flags"]) == ("S", 2.0, "property_reference", "o", None, "location_reference")
    two = old.unionByName(old.withColumns({"street": F.lit("T"), "record_id": F.lit("p")}))
    assert linkage.link_by_property(cur, two).first()["location_basis"] == "unmatched"


def test_dedupe_keeps_the_last(spark):
    cols = {c: F.lit(None).cast("string") for c in linkage.SIGNATURE}
    df = rows(spark, [("k", 1), ("k", 2), (None, 3), (None, 4)], "source_key string, seq int").withColumns(cols).withColumn("city", F.when(F.col("seq") == 4, "Y").otherwise("X"))
    assert sorted((r["source_key"] or "", r["seq"]) for r in linkage.dedupe(df).collect()) == [("", 4), ("k", 2)]


def test_repeat_sales_count_days(spark):
    d = lambda y: datetime.date(y, 1, 1)
    df = rows(spark, [("a", d(2000), 50.0, 2.0, "X"), ("a", d(2000), 50.0, 2.0, "X"), ("a", d(2001), 50.0, 2.0, "X"), ("b", d(2000), 50.0, 2.0, "X")], "unit_key string, deal_date date, area double, rooms double, city string")
    got = quality.repeat_sales(df).first()
    assert (got["properties"], got["dates_2plus"], got["collapsed"], got["years_2plus"]) == (2, 1, 1, 1)
    assert quality.consistent_units(df).count() == 4


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.csv").write_text("x,y\n1,\n2,b\n", encoding="utf-8")
    raw = tables.read_snapshot(spark, [{"version_number": 1, "files": ["no.csv"]}, {"version_number": 2, "files": ["a.csv"]}], str(tmp_path / "raw"))
    assert sorted((r["x"], r["y"], r["source_row"], r["source_id"]) for r in raw.collect()) == [("1", None, 2, "a.csv:2"), ("2", "b", 3, "a.csv:3")]
    inv = rows(spark, [("a.csv", "0" * 64, 2), ("b.csv", "", 1)], "file string, sha256 string, rows long")
    assert {(r["file"], r["problem"]) for r in tables.check_files(spark, str(tmp_path / "raw"), inv).collect()} == {("a.csv", "checksum"), ("b.csv", "missing")}
    df = rows(spark, [("X", 1.0), ("Y", 2.0)], "city string, price_millions double")
    tables.publish(df, df.groupBy("city").count(), str(tmp_path / "out"))
    assert tables.read_deals(spark, str(tmp_path / "out/cities"), ["X", "X"]).select("price_millions").collect()[0][0] == 1.0
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_deals(df, str(tmp_path / "out/cities"))
    tables.write_export(df, str(tmp_path / "csv"), single=True)
    assert next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()[0] == "City,Price (millions)"
    (tmp_path / "p.json").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"GUSH_NUM": 7, "LOCALITY_N": "X", "FID": 1}, "geometry": {"type": "Point"}}]}')
    assert tables.read_polygons(spark, str(tmp_path / "p.json")).first()["gush"] == 7
    (tmp_path / "q.json").write_text('{"type": "Feature"}')
    with pytest.raises(Exception, match="feature collection"):
        tables.read_polygons(spark, str(tmp_path / "q.json")).collect()
    (tmp_path / "i.csv").write_text("Year,index_shekels\n1990,100\nx,5\n1991,\n")
    assert [tuple(r) for r in tables.read_index(spark, str(tmp_path / "i.csv")).collect()] == [(1990, 100.0)]
    (tmp_path / "t.json").write_text('["b", "a"]')
    assert tables.read_types(spark, str(tmp_path / "t.json")).count() == 2
    tables.write_report(df, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


LOOK_OLD = "record_id string, city string, unit_key string, deal_date date, price_millions double, area double, rooms double, build_year double, full_address string, floor double"
LOOK_NEW = "record_id string, city string, unit_key string, deal_date date, price_millions double, area double, rooms double, build_year double, sale_portion double"


def test_lookup_is_sure_only_of_sales_that_are_alone_in_all_rows(spark):
    """A legacy row of the same property and day at another address stands against confirmation; one without a key is listed."""
    old = rows(spark, [("o1", "X", "k1", DAY, 2.0, 80.0, 3.0, 2000.0, "Red 12", 2.0), ("o2", "X", "k2", DAY, 3.0, 70.0, 3.0, 1990.0, "red 12", 1.0), ("o3", "X", "k2", DAY, 9.0, 70.0, 3.0, 1990.0, "Blue 5", 4.0), ("o4", "X", "k3", DAY, 1.0, 50.0, 2.0, None, "red 112", 1.0), ("o5", "X", None, DAY, 4.0, 50.0, 2.0, None, "12 old red", 7.0)], LOOK_OLD)
    cur = rows(spark, [("n1", "X", "k1", DAY, 2.001, 81.0, 3.0, 2000.0, 1.0), ("n2", "X", "k2", DAY, 3.0, 70.0, 3.0, 1990.0, 1.0), ("n3", "X", "k3", DAY, 1.0, 50.0, 2.0, 1990.0, 1.0)], LOOK_NEW)
    look = lambda **how: {r["record_id"]: (r["status"], r["legacy_record_id"], r["reference_address"], r["reference_floor"], r["conflicts"]) for r in addresses.lookup_address(old, cur, "רחוב red 12", years=(1900, 2100), **how).collect()}
    loose = {"o5": ("legacy", None, "12 old red", "7", "share unknown")}
    assert look() == {"n1": ("confirmed", "o1", "Red 12", "2", "area"), "n2": ("candidate", None, "red 12", "1", "references"), "o2": ("legacy", None, "red 12", "1", "share unknown")} | loose
    assert set(look(floor=1.0)) == {"n2", "o2"} and set(look(floor=7.0)) == {"o5"}
    assert look(most=1) == {None: ("refused", None, None, None, "too many properties")}


def test_lookup_of_one_house_over_two_sources(spark):
    """One pair of a day is one row; the house with a longer number stays out; what stands against a pair undoes it."""
    d = datetime.date
    old = rows(spark, [("l1", "T", "1-2-3", d(2023, 1, 1), 5.4, 105.8, 5.0, 1990.0, "בויאר אברהם 12", 5.0), ("l2", "T", "1-2-4", d(2015, 1, 1), 2.0, 80.0, 3.0, 1990.0, "בויאר אברהם 12", 5.0), ("l3", "T", "1-2-5", d(2016, 1, 1), 2.0, 80.0, 3.0, 1990.0, "בויאר אברהם 120", 5.0)], LOOK_OLD)
    new = [("a", "T", "1-2-3", d(2023, 1, 1), 5.4, 98.0, 4.0, 1994.0, 1.0), ("b", "T", "1-2-3", d(2020, 1, 1), 3.85, 98.0, 5.0, 1987.0, 1.0)]
    look = lambda cur, **how: sorted((r["deal_date"].year, r["status"], r["record_id"], r["legacy_area"], r["conflicts"]) for r in addresses.lookup_address(old, rows(spark, cur, LOOK_NEW), "בויאר 12", **({"floor": 5.0, "years": (2014, 2026)} | how)).collect())
    assert look(new) == [(2015, "legacy", "l2", None, "share unknown"), (2020, "candidate", "b", None, "unchecked"), (2023, "confirmed", "a", 105.8, "area,rooms,build_year")]
    assert len(look([*new, ("c", *new[0][1:])])) == 5
    assert len(look([(*new[0][:-1], 0.5), new[1]])) == 4
    assert look(new, floor=4.0) == []
    assert len(look([])) == 2


def test_many_lookups_equal_one_by_one(spark):
    rnd = random.Random(4)
    streets = ["red", "green", "dark red", "ז׳בוטינסקי", "Å street", "a-b 3/4"]
    old = rows(spark, [(f"o{i}", rnd.choice("XY"), rnd.choice([None, *(f"k{k}" for k in range(30))]), DAY + datetime.timedelta(rnd.randint(0, 3)), float(rnd.randint(1, 3)), 50.0, 2.0, None, rnd.choice([None, f"{rnd.choice(streets)} {rnd.randint(1, 13)}, {rnd.choice('XY')}"]), rnd.choice([1.0, 2.0, 999.0, None])) for i in range(300)], LOOK_OLD)
    cur = rows(spark, [(f"n{i}", rnd.choice("XY"), f"k{rnd.randint(0, 30)}", DAY + datetime.timedelta(rnd.randint(0, 3)), float(rnd.randint(1, 3)), 50.0, 2.0, None, rnd.choice([1.0, 0.5])) for i in range(300)], LOOK_NEW)
    asked = [(f"q{i}", c, a, f) for i, (c, a, f) in enumerate((c, a, f) for c in "XYZ" for a in ("red 1", "1", "RED 12", "זבוטינסקי 3", "3 4", "å 2", "d 1", "רחוב", "x", "", None) for f in (None, 1.0))]
    many = addresses.lookup_addresses(old, cur, rows(spark, asked, "query_id string, city string, address string, floor double"), most=20)
    got = {}
    for r in many.collect():
        got.setdefault(r["query_id"], set()).add(tuple(r)[1:])
    for q, c, a, f in rnd.sample(asked, 6):
        one = addresses.lookup_address(old, cur, a or "", city=c, floor=f, most=20)
        assert {tuple(r)[1:] for r in one.collect()} == got.get(q, set()), (c, a, f)
    texts = {q: filters.address_ok(a, "full_address") for q, c, a, f in asked if a and f is None and c == "X" and len(a) > 1 and filters.tokens(a, clean.ADDRESS_STOP)}
    addr = old.select("city", "full_address").where("city = 'X' and full_address is not null").distinct().persist()
    met = {(r[0], r[2]) for r in addresses.match_addresses(addr, addresses.read_queries(rows(spark, asked, "query_id string, city string, address string, floor double")).where("refused is null")).collect()}
    for q, test in texts.items():
        assert {r[1] for r in addr.where(test).collect()} == {a for k, a in met if k == q}, q


def test_partners_within_a_tolerance(spark):
    """Bands find what comparing all pairs of a day finds, on a day with many equal prices too."""
    rnd = random.Random(9)
    make = lambda n, tag: [(rnd.choice(["u", "v", "w"]), rnd.choice([1000.0 * rnd.randint(1, 40), rnd.uniform(0, 40_000), -500.0, None]), f"{tag}{i}") for i in range(n)] + [("hot", 5000.0, f"{tag}h{i}") for i in range(20 if tag == "a" else 1)]
    a, b = make(60, "a"), make(60, "b")
    got = {r["id"]: (r["partners"], r["partner"]) for r in linkage.partners(rows(spark, a, "unit string, price double, id string"), rows(spark, b, "unit string, price double, id string"), ["unit"], 1000.0).collect()}
    for unit, price, i in a:
        near = [j for u, p, j in b if u == unit and p is not None and price is not None and abs(p - price) <= 1000]
        assert got[i] == (min(2, len(near)), near[0] if len(near) == 1 else None), (unit, price)


def test_quantiles_of_groups_and_windows(spark):
    rnd = random.Random(6)
    data = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2, 3, None]), rnd.choice([None, rnd.uniform(-5, 5), float(rnd.randint(-3, 3)), 10.0 ** rnd.randint(-9, 9)])) for _ in range(800)] + [("none", 9, None)]
    df = rows(spark, data, "g string, y int, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["y"]): (r["rows"], r["n"], r["q"]) for r in quantiles.quantiles(df, ["g", "y"], "v", probs).collect()}
    want = df.groupBy("g", "y").agg(F.count("*").alias("rows"), F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect()
    assert set(got) == {(r["g"], r["y"]) for r in want}
    for r in want:
        n, k, q = got[r["g"], r["y"]]
        assert (n, k) == (r["rows"], r["n"])
        assert q == [None] * 5 if r["q"] is None else q == pytest.approx(r["q"], rel=1e-12), r
    spread = rows(spark, [(y, w) for w in (1, 2, 3) for y in range(w - 1, w + 2)], "y int, w int")
    got = {r["w"]: (r["n"], r["q"]) for r in quantiles.quantiles(df.where("v is not null"), ["y"], "v", [0.25, 0.75], spread).collect()}
    for w in (1, 2, 3):
        values = df.where(F.col("y").between(w - 1, w + 1) & F.col("v").isNotNull())
        r = values.agg(F.count("*"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.75)))).first()
        assert got[w][0] == r[0] and got[w][1] == pytest.approx(r[1], rel=1e-12)
    assert [tuple(r) for r in quantiles.quantiles(df.limit(0), [], "v", [0.5]).collect()] == [(0, 0, [None])]
    assert quantiles.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_index_by_group_equals_each_group_alone(spark):
    rnd = random.Random(3)
    data = []
    for city, step in (("A", 1.05), ("B", 0.97), (None, 1.2)):
        for year in (2019, 2020, 2021):
            for _ in range(60):
                area = rnd.choice([40.0, 60.0, 85.0, 120.0])
                price = step ** (year - 2019) * 0.03 * area**0.8 * math.exp(rnd.gauss(0, 0.05)) * (30 if rnd.random() < 0.02 else 1)
                data.append((city, float(year), price, area, rnd.choice([2.0, 3.0, 999.0]), rnd.choice([1.0, 4.0, None]), rnd.choice([1.0, 30.0]), rnd.choice("abcdefgh") + (city or "")))
    data += [("few", 2020.0, 1.0, 50.0, 2.0, 1.0, 1.0, "a")] * 10
    df = rows(spark, data, "city string, deal_year double, price_millions double, area double, rooms double, floor double, building_age double, apt_type string").persist()
    got = segments.hedonic_index(df, ["city"]).collect()
    assert {r["city"] for r in got} == {"A", "B", None}
    for city in ("A", None):
        alone = segments.hedonic_index(df.where(F.col("city").eqNullSafe(F.lit(city)))).collect()
        assert sorted(tuple(r)[1:] for r in got if r["city"] == city) == sorted(map(tuple, alone))
    assert any(r["excluded"] > 0 for r in got)


def test_search_wants_all_words_in_one_column(spark):
    df = rows(spark, [(1, "red 12", "x"), (2, "red", "12"), (3, "red 121", "x"), (4, None, "12, Red")], "id int, a string, b string")
    assert sorted(r[0] for r in filters.search_rows(df, "Red 12").collect()) == [1, 4]
    assert filters.search_rows(df, "").count() == 4
