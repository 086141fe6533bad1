"""Positions in files, publishing, digests, masks, postings and samples, against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from dealforge.operators import flags, linkage, postings, quality
from dealforge.plans import jobs
from dealforge.sources import files, tables


def test_lines_of_files_in_many_splits(spark, tmp_path):
    """Line numbers follow the file where it is read in pieces, and equal rows have their own."""
    texts = {"b.csv": [f"{i % 7},x{i}" for i in range(3000)], "a.csv": ["1,same"] * 500, "empty.csv": []}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(["k,v", *lines]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = tables.read_snapshot(spark, [{"version_number": 1, "files": list(texts)}], str(tmp_path))
        assert got.rdd.getNumPartitions() > 3
        rows = got.select("source_file", "source_row", "k", "v", "source_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.source_file, r.source_row, f"{r.k},{r.v}") for r in rows) == sorted((n, i + 2, t) for n, ts in texts.items() for i, t in enumerate(ts))
    assert len({r.source_id for r in rows}) == 3500


def test_rows_of_cities_are_numbered(spark, tmp_path):
    """Over several files of a city numbers have no gaps; equal rows are told apart."""
    data = [("A" if i % 3 else "B", float(i % 5), None if i % 4 else f"s{i}") for i in range(400)]
    spark.createDataFrame(data, "city string, area double, source_id string").repartition(3).write.partitionBy("city").parquet(str(tmp_path / "d"))
    got = tables.read_deals(spark, str(tmp_path / "d")).select("city", "record_id", "source_id").collect()
    assert len({r.record_id for r in got}) == 400
    assert all(r.record_id == (r.source_id or r.record_id) for r in got)
    numbered = files.with_row_numbers(spark.read.parquet(str(tmp_path / "d")), "city").groupBy("city").agg(F.count("*").alias("n"), F.min("_row").alias("a"), F.max("_row").alias("z"), F.countDistinct("_row").alias("d")).collect()
    assert all((r.a, r.z, r.d) == (0, r.n - 1, r.n) for r in numbered)


def test_digests_stream(spark, tmp_path):
    for name, raw in {"a.csv": b"h\n1\n2", "b.csv": b'h,k\n"x\ny",2\n"q""q",3\n', "c.csv": b"h\n" + b"line\n" * 10_000 + b" \n\n"}.items():
        (tmp_path / name).write_bytes(raw)
    want = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.glob("*.csv")}
    for whole in (files.WHOLE, 8, 0):
        got = {r.file: (r.got_sha256, r.got_rows) for r in files.digests(spark, str(tmp_path), whole).collect()}
        assert {n: d for n, (d, _) in got.items()} == want
        assert got["a.csv"][1] == 2 and got["c.csv"][1] == 10_000
        assert got["b.csv"][1] == 3  # a line is a row


def test_publishing_leaves_all_or_nothing(spark, tmp_path):
    d = spark.createDataFrame([("A", 1, [1.5]), (None, 2, None), ("B", 2, [])], "city string, n int, v array<double>")
    out = tmp_path / "out"
    files.publish_all({"cities": d, "more": d.limit(0), "coverage": d.groupBy("city").count()}, str(out), "coverage", {"cities": "city"})
    assert sorted(p.name for p in out.iterdir() if not p.name.startswith(".")) == ["cities", "coverage", "more"]
    assert sorted(spark.read.parquet(str(out / "cities")).select(*d.columns).collect(), key=repr) == sorted(d.collect(), key=repr)
    with pytest.raises(files.Refused, match="coverage"):
        files.publish_all({"coverage": d}, str(out), "coverage")
    bad = d.withColumn("n", F.when(F.col("n") == 2, F.raise_error(F.lit("no such row"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="no such row"):
        files.publish_all({"cities": d, "coverage": bad}, str(tmp_path / "other"), "coverage")
    assert not [p for p in (tmp_path / "other").iterdir() if not p.name.startswith(".")]
    once = d.withColumn("n", F.rand().cast("string"))  # no two runs say the same, so what was written is not what is asked
    files.publish_all({"coverage": once}, str(tmp_path / "third"), "coverage")


def test_an_import_with_a_wrong_file_publishes_nothing(spark, tmp_path):
    (tmp_path / "raw" / "v1").mkdir(parents=True)
    (tmp_path / "raw" / "v1" / "a.csv").write_text("settlement_code,settlement\n1,A\n2,B\n")
    inventory = lambda sha: spark.createDataFrame([("v1", "a.csv", sha, 2)], "folder string, file string, sha256 string, rows long")
    run = lambda sha: jobs.run_import_second(spark, [{"version_number": 1, "files": ["v1"]}], str(tmp_path / "raw"), inventory(sha), None, "2020-01-01", [], str(tmp_path / "out"))
    with pytest.raises(files.Refused, match="checksum"):
        run("0")
    with pytest.raises(files.Refused, match="2 settlements"):
        run(hashlib.sha256((tmp_path / "raw" / "v1" / "a.csv").read_bytes()).hexdigest())
    assert not (tmp_path / "out").exists()


def test_masks_count_overlapping_conditions(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["a", None]), rnd.choice([None, -1.0, 0.0, 5.0])) for _ in range(200)]
    df = spark.createDataFrame(data, "g string, v double")
    conditions = {"none": F.col("v").isNull(), "low": F.col("v") <= 0, "zero": F.col("v") == 0} | {f"c{i}": F.lit(i == 55) for i in range(56)}
    got = {(r.g, r.measure): r.n for r in flags.count_flags(df, conditions, ["g"]).collect()}
    for g in ("a", None):
        own = [v for k, v in data if k == g]
        assert (got[g, "rows"], got[g, "none"], got[g, "low"], got[g, "zero"], got[g, "c55"], got[g, "c3"]) == (len(own), own.count(None), sum(v is not None and v <= 0 for v in own), own.count(0.0), len(own), 0)
    assert {r.measure: r.n for r in flags.count_flags(df.limit(0), conditions).collect()}["rows"] == 0
    with pytest.raises(ValueError):
        flags.flag_masks(df, {str(i): F.lit(True) for i in range(64)})


def test_parts_are_found_by_postings(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choices("abc דה-", k=rnd.randint(0, 12))) for _ in range(150)] + [None, "", "aaaa"]
    asked = ["".join(rnd.choices("abc ד", k=rnd.randint(1, 6))) for _ in range(60)] + ["", "zzz", "aaaa"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, q string")
    found = postings.find_parts(spark.createDataFrame([(t,) for t in texts], "text string"), queries)
    assert {(r.query_id, r.text) for r in found.collect()} == {(i, t) for i, q in enumerate(asked) for t in texts if q and t is not None and q in t}
    streets = spark.createDataFrame([("A", 7.0, "red way"), ("B", 7.0, "way 12"), ("B", 8.0, None)], "city string, gush double, street string")
    d = spark.createDataFrame([("A", 7.0, "red way", 3, "A 7 (red way)"), ("B", 7.0, "way 12", 3, "B 7 (way 12)")], "city string, gush double, street string, n long, gush_desc string")
    out = linkage.search_gush(spark.createDataFrame([("WAY",), ("7",), ("",), (None,)], "query string"), d, streets)
    assert sorted((r["query"], r.city, r.rank) for r in out.collect()) == [("7", "A", 0), ("7", "B", 0), ("WAY", "A", 1), ("WAY", "B", 0)]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_samples_of_extras_are_stable(spark):
    base = [(float(i % 9), f"k{i % 40}", "2020-01-0" + str(1 + i % 3), "c") for i in range(300)]
    cols = "price double, gush_code string, deal_date string, city string"
    snapshot = spark.createDataFrame(base[:100], cols)
    append = spark.createDataFrame([(p + 1, k, d, c) for p, k, d, c in base] + [(p, k, d, "") for p, k, d, c in base[:30]], cols)
    report = lambda a: quality.append_report(snapshot, a, "city", "city", ["price", "gush_code", "deal_date"], ["gush_code", "deal_date"])
    one, two = (sorted(map(tuple, report(a)["samples"].collect())) for a in (append, append.orderBy(F.desc("price")).repartition(7)))
    assert one == two and 0 < len(one) <= 60
    counts = {r.measure: r.n for r in report(append)["counts"].collect()}
    assert counts["rows"] == counts["matching_without_place"] + counts["unmatched_without_place"] and counts["missing_place"] == 30
    assert "WindowGroupLimit" in report(append)["samples"]._jdf.queryExecution().executedPlan().toString()
