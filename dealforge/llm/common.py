"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_TABLE = {ord(c): c.lower() for c in UPPER}


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def word_list(text: str | None, lower: bool = False) -> list[str]:
    """The words of a text; a null text has none."""
    if not text:
        return []
    return WORD_RE.findall(text.translate(LOWER_TABLE) if lower else text)


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset, and only for a local master, a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back; cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what ``saved`` wrote for these; nothing may read them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


ARROW_ROWS, SMALL_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session's Arrow batches are made small where it left them at Spark's default.

    Whole texts of 10,000 rows would be held at once by the JVM and by Python otherwise.
    """
    if df.sparkSession.conf.get(ARROW_ROWS) == "10000":
        df.sparkSession.conf.set(ARROW_ROWS, str(SMALL_ROWS))
    return df


def give_back() -> None:
    """Hand free memory back to the system, as an idle worker keeps its pages otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that carry one of these names in any case."""
    drop = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in drop])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that ``df`` has already."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def pieces(batches, rows: int = 2_000):
    """Record batches of at most ``rows`` rows, so that what a task holds in Python stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def map_batches(df: DataFrame, make, new: list[tuple[str, str]], keep: list[str] | None = None, rows: int = 2_000) -> DataFrame:
    """Add the columns that ``make(batch) -> dict`` computes from each Arrow batch.

    ``keep`` names the input columns to carry on (default: all). A new column replaces an old
    one of the same name, whatever its case. ``make`` gets at most ``rows`` rows at once.
    """
    fresh = {n.lower() for n, _ in new}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in fresh]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"`{n}` {t}" for n, t in new])

    def run(batches):
        for b in pieces(batches, rows):
            got = make(b)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [got[n] for n, _ in new], names=kept + [n for n, _ in new])
            del b, got
        give_back()

    return small_batches(df).mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, col: str) -> list[str]:
    """The column's texts, nulls as empty."""
    return [x or "" for x in batch.column(col).to_pylist()]


#: Two odd constants of splitmix64.
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x
