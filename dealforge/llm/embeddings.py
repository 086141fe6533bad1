"""Near-duplicate vectors by an inverted multi-index, exactly.

Vectors are split in halves, each half has a codebook of its own, and pairs of codewords are the
cells of a grid. Every vector is filed in its nearest cell. Cells are packed into regions, a crowded
cell is dealt out over regions of its own. A query visits every region that has a cell which, by the
distance bounds of its codewords, may hold a vector within the cosine; there is no ceiling and
nothing is estimated, so every link is found. What meets is verified by cosine in double precision.

Codebooks are fitted on at most ``FIT_ROWS`` vectors and have at most ``MAX_CODES`` words; every
vector is indexed, and they only decide how much is compared. Two regions meet once, the vectors of
the one asking in the other. A block returns counts and a spanning set of links, never its pairs.

Cases: a null or zero vector or one with null or non-finite components links with nothing; vectors
link with those of their own length; identical vectors are compared once; ties do not matter, as
all links count; other columns are not carried, whatever their names; rows with a null id have no
links; several rows with one id count as one vector, the first by content; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix64, pieces, saved
from .graph import components

COSINE = 0.95
FIT_ROWS = 20_000
MAX_CODES = 128
#: Vectors of a region, of a block of queries, and of queries that are compared at once.
FILED, ASKING, AT_ONCE = 8_192, 8_192, 256
#: What rounding may add to a squared distance, and the least distance of codewords that is told apart.
ROUNDING, APART = 1e-6, 1e-6
SEED = 17


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, raw)``: one row per id; ``raw`` holds the doubles of a usable vector, else null."""

    def run(batches):
        for b in batches:
            raws = []
            for v in b.column("v").to_pylist():
                x = None if v is None or None in v else np.array(v, np.float64)
                raws.append(x.tobytes() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(raws, pa.binary())], names=["id", "raw"])

    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    return rows.where("id is not null").mapInArrow(run, "id bigint, raw binary").groupBy("id").agg(F.min("raw").alias("raw"))


def _matrix(raws) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), np.float64).reshape(len(raws), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _distances(x, centres).argmin(axis=1)
        for j in range(len(centres)):
            mine = x[near == j]
            if len(mine):
                centres[j] = mine.mean(axis=0)
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


class MultiIndex:
    """Two codebooks and the bounds of their grid."""

    def __init__(self, sample: np.ndarray, codes: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        self.left = _codebook(sample[:, : self.half], codes, rng)
        self.right = _codebook(sample[:, self.half :], codes, rng)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(x[:, : self.half], self.left), _distances(x[:, self.half :], self.right)

    def own(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each row and the distances of its halves from the cell's codewords."""
        d1, d2 = self.halves(x)
        i, j = d1.argmin(1), d2.argmin(1)
        far = lambda d, at: np.sqrt(np.maximum(np.take_along_axis(d, at[:, None], 1)[:, 0], 0))
        return i * len(self.right) + j, far(d1, i), far(d2, j)

    def reach(self, x: np.ndarray, cells: np.ndarray, far1: np.ndarray, far2: np.ndarray, cosine: float) -> np.ndarray:
        """Whether a cell, with its vectors' largest distances, may hold a vector within ``cosine`` of a row."""
        total = 0.0
        for d, codes, at, far in zip(self.halves(x), (self.left, self.right), (cells // len(self.right), cells % len(self.right)), (far1, far2), strict=True):
            near = d.argmin(1)
            gap = np.sqrt(np.maximum(_distances(codes, codes), 0))[near]
            # a filed vector is on its codeword's side of the plane between that and the row's nearest one
            plane = np.where(gap > APART, (d - np.take_along_axis(d, near[:, None], 1)) / (2 * np.maximum(gap, APART)), 0.0)
            ball = np.sqrt(np.maximum(d, 0))[:, at] - far
            total = total + np.maximum(np.maximum(plane[:, at], ball), 0) ** 2
        return total <= 2 - 2 * cosine + ROUNDING


def fit(vectors: DataFrame, count: int) -> MultiIndex:
    """The index's codebooks from a sample of at most ``FIT_ROWS`` of ``(rep, raw)``."""
    sample = vectors.orderBy(F.xxhash64("rep"), "rep").limit(FIT_ROWS).select("raw").toPandas()["raw"]
    codes = max(2, min(MAX_CODES, int(math.sqrt(count / 32))))
    return MultiIndex(_matrix([bytes(r) for r in sample]), codes)


class Regions:
    """Occupied cells packed in their order into regions of about ``size`` vectors."""

    def __init__(self, cells: np.ndarray, n: np.ndarray, far1: np.ndarray, far2: np.ndarray, size: int):
        self.cells, self.far1, self.far2 = cells, far1, far2
        self.first, self.parts = np.zeros(len(cells), np.int64), np.maximum(1, -(-n // size))
        region, held = -1, size
        for k in range(len(cells)):
            if held + n[k] > size:
                region, held = region + 1, 0
            self.first[k] = region
            held += n[k]
            region += int(self.parts[k]) - 1
        self.count = region + 1
        #: Each region with each of its cells, by region.
        self.of_cell = np.repeat(np.arange(len(cells)), self.parts)
        self.region = np.repeat(self.first, self.parts) + np.arange(len(self.of_cell)) - np.repeat(np.cumsum(self.parts) - self.parts, self.parts)
        self.heads = np.flatnonzero(np.diff(self.region, prepend=-1))

    def own(self, cell: np.ndarray, rep: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.cells, cell)
        return self.first[at] + (mix64(rep.view(np.uint64)) % self.parts[at].astype(np.uint64)).astype(np.int64)

    def visits(self, index: MultiIndex, x: np.ndarray, cosine: float) -> np.ndarray:
        """Which regions each row has to visit."""
        may = index.reach(x, self.cells, self.far1, self.far2, cosine)
        return np.logical_or.reduceat(may[:, self.of_cell], self.heads, axis=1)


def _links(x: np.ndarray, y: np.ndarray, mult_x: np.ndarray, mult_y: np.ndarray, top_x: np.ndarray, top_y: np.ndarray, cosine: float, same: bool):
    """Link counts of ``x`` and ``y``; labels fall in place, and pairs of an old and a new label are returned.

    ``same`` compares the rows of one table, each two once.
    """
    n_x, n_y, falls = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), []
    for i in range(0, len(x), AT_ONCE):
        own = slice(i, min(i + AT_ONCE, len(x)))
        to = slice(i if same else 0, len(y))
        linked = x[own] @ y[to].T >= cosine
        if same:
            linked = np.triu(linked, 1)
        rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        if not len(rows):
            continue
        linked = linked[np.ix_(rows, cols)]
        rows, cols = rows + own.start, cols + to.start
        n_x[rows] += linked @ mult_y[cols]
        n_y[cols] += mult_x[rows] @ linked
        big = np.iinfo(np.int64).max
        old_x, old_y = top_x[rows], top_y[cols]
        new_x, new_y = old_x, old_y
        while True:
            low_x = np.minimum(new_x, np.where(linked, new_y, big).min(1))
            low_y = np.minimum(new_y, np.where(linked, low_x[:, None], big).min(0))
            if (low_x == new_x).all() and (low_y == new_y).all():
                break
            new_x, new_y = low_x, low_y
        top_x[rows], top_y[cols] = new_x, new_y
        pairs = np.stack([np.concatenate([old_x, old_y]), np.concatenate([new_x, new_y])], 1)
        falls.append(np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0))
    return n_x, n_y, falls


def _verify(cosine: float):
    """Count links and span them within a region and one block of those who visit it."""

    def run(key, table):
        asks = table.column("asks").to_numpy()
        rep, mult = (table.column(c).to_numpy().astype(np.int64) for c in ("rep", "mult"))
        x = _matrix(table.column("raw").to_pylist())
        q, r = np.flatnonzero(asks), np.flatnonzero(~asks)
        top_q, top_r = rep[q], rep[r]
        n_q, n_r, falls = _links(x[q], x[r], mult[q], mult[r], top_q, top_r, cosine, False)
        if key[1].as_py() == 0:  # the region itself
            a, b, more = _links(x[r], x[r], mult[r], mult[r], top_r, top_r, cosine, True)
            n_r += a + b
            falls += more
        some, n = np.concatenate([rep[q], rep[r]]), np.concatenate([n_q, n_r])
        some, n = some[n > 0], n[n > 0]
        pairs = np.concatenate(falls) if falls else np.zeros((0, 2), np.int64)
        return pa.table({"rep": np.concatenate([some, pairs[:, 0]]), "n": np.concatenate([n, np.zeros(len(pairs), np.int64)]), "top": np.concatenate([some, pairs[:, 1]])})

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``(id, n_links, component, kept)`` for each id.

    Each length of vector that occurs twice has an index of its own, one after the other.
    """
    rows = saved(usable(df, id_col, vec_col), "vectors")
    vectors = saved(rows.where(F.col("raw").isNotNull()).groupBy("raw").agg(F.min("id").alias("rep"), F.count("*").alias("mult")), "vector-classes")
    lengths = [(r["len"], r["count"]) for r in vectors.groupBy(F.length("raw").alias("len")).count().where("count > 1").orderBy("len").collect()]
    met = df.sparkSession.createDataFrame([], MET)
    for length, count in lengths:
        met = met.unionByName(_met(vectors.where(F.length("raw") == length), count, cosine))
    counts = met.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = components(met.select(F.col("rep").alias("a"), F.col("top").alias("b")))
    classes = vectors.join(counts, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("raw", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(classes, "raw", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component"), (F.col("id") == component).alias("kept"))


MET = "rep bigint, n bigint, top bigint"


def _met(vectors: DataFrame, count: int, cosine: float) -> DataFrame:
    """``(rep, n, top)``: link counts and links that span what the rows of ``vectors``, all of one length, connect."""
    spark = vectors.sparkSession
    index = fit(vectors, count)
    shared = spark.sparkContext.broadcast(index)

    def locate(batches):
        for b in batches:
            cell, far1, far2 = shared.value.own(_matrix(b.column("raw").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(far1), pa.array(far2)], names=["cell", "far1", "far2"])

    # one row per cell of the grid, at most MAX_CODES squared
    cells = vectors.select("raw").mapInArrow(locate, "cell bigint, far1 double, far2 double").groupBy("cell")
    cells = cells.agg(F.count("*").alias("n"), F.max("far1").alias("far1"), F.max("far2").alias("far2")).orderBy("cell").toPandas()
    regions = spark.sparkContext.broadcast(Regions(*(cells[c].to_numpy() for c in ("cell", "n", "far1", "far2")), FILED))

    def file(batches):
        for b in pieces(batches, 500):
            x, rep = _matrix(b.column("raw").to_pylist()), b.column("rep").to_numpy()
            own = regions.value.own(shared.value.own(x)[0], rep)
            there = regions.value.visits(shared.value, x, cosine)
            there[np.arange(regions.value.count) <= own[:, None]] = False
            ends = np.concatenate([[0], there.sum(1).cumsum()]).astype(np.int32)
            visits = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(there)[1]))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("mult"), b.column("raw"), pa.array(own), visits], names=["rep", "mult", "raw", "own", "visits"])

    filed = saved(vectors.select("rep", "mult", "raw").mapInArrow(file, "rep bigint, mult bigint, raw binary, own bigint, visits array<bigint>"), "vectors-filed")
    load = filed.select(F.explode("visits").alias("region")).groupBy("region").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("qs"))
    load = F.broadcast(saved(load, "regions"))
    cols = ["rep", "mult", "raw"]
    asking = filed.select(F.explode("visits").alias("region"), *cols).join(load, "region")
    asking = asking.select("region", F.pmod(F.xxhash64("rep"), "qs").cast("int").alias("qb"), F.lit(True).alias("asks"), *cols)
    held = filed.select(F.col("own").alias("region"), *cols).join(load, "region", "left")
    held = held.select("region", F.explode(F.sequence(F.lit(0), F.coalesce("qs", F.lit(1)) - 1)).alias("qb"), F.lit(False).alias("asks"), *cols)
    met = asking.unionByName(held).groupBy("region", "qb").applyInArrow(_verify(cosine), MET)
    return saved(met, "vector-links")
