"""Jaccard join of texts on word shingles by T-occurrence search.

Two texts link when 100 times their common shingles reach ``percent`` times their union. The join
finds the connected components of these links without making all pairs of a group:

1. Texts with the same shingle set become one representative.
2. A linked pair shares at least ``k`` of each side's ``n - T + k`` smallest hashes, where T is
   the overlap that a link takes. Representatives with fewer shared hashes in that prefix have no
   link. Of the rest, those need T shared hashes in their whole set.
3. What is left is ordered by document frequency, rarest first; linked texts share one of their
   first ``n - T + 1`` shingles. Shingles with the same owners are one list.
4. Each text is compared with the most central owner of one of its lists. Only lists whose owners
   these links leave apart are searched, those with an owner in common together: owners not
   connected to their list's centre against all, in blocks of both, by T-occurrence with DivideSkip. Short inverted lists are merged, long
   ones probed by binary search, and texts that reach the required overlap are checked exactly. A
   block reports links that span what it found connected.

Shingles are compared by 64-bit hashes of five lower-cased words; two texts would have to hold
different shingles of one hash to be misjudged.

Cases: a text of fewer words is one shingle of them all; a null text or one without words has an
empty set and links with nothing; a very long text is one set like any other and is never cut; rows
with a null id are their own and get a null component; repeated rows and ties fall together under
the smallest id; columns besides id and text are carried by ``one_of_each`` whatever their names;
empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import discard, give_back, map_batches, mix64, saved, small_batches, texts
from .graph import components
from .wordhash import word_hashes

WORDS = 5
PERCENT = 80
#: Extra share of a set that goes into the prefix and that a linked pair must then share there.
EXTRA = 0.1
#: Items in a block of queries and in a block of the searched group.
QUERY_ITEMS, INDEX_ITEMS = 50_000, 200_000
#: Ids that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
MU = 0.01
KEPT_ID = "kept_id"


def shingles(text: str, size: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text, as signed integers."""
    w = word_hashes(text)[0]
    if not len(w):
        return np.zeros(0, np.int64)
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = mix64(h * np.uint64(31) + w[j : len(w) - k + 1 + j])
    return np.unique(h.view(np.int64))


def least_overlap(n, percent: int = PERCENT):
    """The overlap that any link of a set of ``n`` takes."""
    return -(-n * percent // 100)


def _lists(rows: list[np.ndarray], kind=pa.int64()) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), kind))


def signed(df: DataFrame, size: int, percent: int, extra: float) -> DataFrame:
    """``(id, n, sig, prefix)``: set size, the set's signature and its smallest hashes."""

    def make(b):
        sets = [shingles(t, size) for t in texts(b, "text")]
        ns = np.array([len(s) for s in sets], np.int64)
        ks = np.maximum(1, (ns * extra).astype(np.int64))
        take = np.minimum(ns, ns - least_overlap(ns, percent) + ks)
        return {"n": pa.array(ns), "sig": pa.array([_signature(s) for s in sets], pa.binary()), "prefix": _lists([s[:p] for s, p in zip(sets, take, strict=True)])}

    return map_batches(df, make, [("n", "bigint"), ("sig", "binary"), ("prefix", "array<bigint>")], ["id"])


def _signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _dealt(part: np.ndarray, parts: int, *cols: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """The numbers of the parts that have rows, and each column packed by part."""
    by = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[by], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(ends))
    return full, [[c[ends[p] : ends[p + 1]].tobytes() for p in full] for c in (x[by] for x in cols)]


def _unpacked(batches, *cols: str) -> list[np.ndarray]:
    got: list[list[np.ndarray]] = [[] for _ in cols]
    for b in batches:
        for held, c in zip(got, cols, strict=True):
            held += [np.frombuffer(x, np.int64) for x in b.column(c).to_pylist()]
    return [np.concatenate(g) if g else np.zeros(0, np.int64) for g in got]


#: Kinds of packed rows: sets that ask whether an item is shared, items known to be, tallies of sets.
ASK, SURE, TALLY = range(3)
PACKED = "kind tinyint, part int, reps binary, items binary"


def shared_items(sets: DataFrame, items: str) -> DataFrame:
    """``(rep, shared)``: how many of a set's items some other set has too.

    Items are dealt out by their hash in packed blocks, so that a shuffled row carries many; the
    counts go back to their sets the same way. What sets of one batch share is counted there and
    sends one mark, so a part gets an item at most once from each batch, however hot it is.
    """
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 2 * max(16, n)

    def record(kind, full, reps, held):
        none = pa.nulls(len(full), pa.binary())
        cols = [pa.array(np.full(len(full), kind, np.int8)), pa.array(full.astype(np.int32)), none if reps is None else pa.array(reps, pa.binary()), pa.array(held, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["kind", "part", "reps", "items"])

    def of(x, parts):
        return (mix64(x.view(np.uint64)) % np.uint64(parts)).astype(np.int64)

    def tallies(ids, k):
        full, cut = _dealt(of(ids, n), n, ids, k)
        return record(TALLY, full, *cut)

    def pack(batches):
        for b in batches:
            col = b.column("items")
            flat = col.flatten().to_numpy(zero_copy_only=False)
            reps = np.repeat(b.column("rep").to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy()))
            by = np.argsort(flat)
            flat, reps = flat[by], reps[by]
            alone = ~_twice(flat)
            full, cut = _dealt(of(flat[alone], parts), parts, reps[alone], flat[alone])
            yield record(ASK, full, *cut)
            if not alone.all():
                one = np.unique(flat[~alone])
                full, (cut,) = _dealt(of(one, parts), parts, one)
                yield record(SURE, full, None, cut)
                yield tallies(*np.unique(reps[~alone], return_counts=True))

    def count(batches):
        got: list[list[np.ndarray]] = [[], [], []]
        for b in batches:
            kind = b.column("kind").to_numpy()
            done = pa.array(kind == TALLY)
            if (kind == TALLY).any():
                yield b.filter(done)
            for k, reps, held in zip(kind.tolist(), b.column("reps").to_pylist(), b.column("items").to_pylist(), strict=True):
                if k == ASK:
                    got[0].append(np.frombuffer(reps, np.int64))
                if k != TALLY:
                    got[1 if k == ASK else 2].append(np.frombuffer(held, np.int64))
        r, asked, sure = (np.concatenate(g) if g else np.zeros(0, np.int64) for g in got)
        f = np.concatenate([asked, sure])
        by = np.argsort(f)
        twice = np.zeros(len(f), bool)
        twice[by] = _twice(f[by])
        ids, k = np.unique(r[twice[: len(r)]], return_counts=True)
        if len(ids):
            yield tallies(ids, k)
        give_back()

    def add(batches):
        r, k = _unpacked(batches, "reps", "items")
        ids, at = np.unique(r, return_inverse=True)
        total = np.bincount(at, k, len(ids)).astype(np.int64)
        for i in range(0, len(ids), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 100_000]), pa.array(total[i : i + 100_000])], names=["rep", "shared"])
        give_back()

    packed = small_batches(sets).select("rep", F.col(items).alias("items")).mapInArrow(pack, PACKED)
    counted = packed.repartition(n, "part").mapInArrow(count, PACKED)
    return counted.repartition(n, "part").mapInArrow(add, "rep bigint, shared bigint")


def _twice(ranked: np.ndarray) -> np.ndarray:
    """Which of a sorted array's values it holds more than once."""
    same = ranked[1:] == ranked[:-1]
    return np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(ranked) else np.zeros(0, bool)


def _semi(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, on)


def _search(percent: int):
    """Links of a block of queries within a block of their group, as a forest that spans them."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table.column("asks").to_numpy()
        col = table.column("items").combine_chunks()
        flat, ends = col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy()
        rep, label = table.column("rep").to_numpy(), table.column("label").to_numpy()
        out = search_block(rep, label, [flat[ends[i] : ends[i + 1]] for i in range(len(rep))], asks, percent)
        give_back()
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def search_block(rep: np.ndarray, label: np.ndarray, sets: list[np.ndarray], asks: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges ``(a, b)`` that connect what the links of the sets that ask to the others connect.

    Sets of one label are known to be connected. T-occurrence search with DivideSkip.
    """
    held = np.flatnonzero(~asks)
    sizes = np.array([len(sets[i]) for i in held], np.int64)
    if not len(held):
        return []
    flat = np.concatenate([sets[i] for i in held])
    owner = np.repeat(np.arange(len(held)), sizes)
    by = np.lexsort((owner, flat))
    flat, owner = flat[by], owner[by]
    ids, labels = rep[held], label[held]
    tops: dict[int, int] = {}

    def top(x: int) -> int:
        while tops.setdefault(x, x) != x:
            tops[x] = tops[tops[x]]
            x = tops[x]
        return x

    out = []
    for q in np.flatnonzero(asks):
        items = sets[q]
        lo, hi = np.searchsorted(flat, items), np.searchsorted(flat, items, "right")
        size = hi - lo
        need = least_overlap(len(items), percent)
        # DivideSkip: set the longest lists aside, fewer than the overlap asked for
        aside = min(need - 1, int(need / (MU * np.log2(max(2, size.max())) + 1)))
        order = np.argsort(size, kind="stable")
        short, long = order[: len(order) - aside], order[len(order) - aside :]
        merged = np.concatenate([owner[lo[i] : hi[i]] for i in short]) if len(short) else np.zeros(0, np.int64)
        seen, hits = np.unique(merged, return_counts=True)
        some = (hits >= need - aside) & (labels[seen] != label[q]) & (100 * sizes[seen] >= percent * len(items)) & (100 * len(items) >= percent * sizes[seen])
        seen, hits = seen[some], hits[some]
        for i in long:
            if not len(seen):
                break
            one = owner[lo[i] : hi[i]]
            if len(one):
                at = np.minimum(np.searchsorted(one, seen), len(one) - 1)
                hits = hits + (one[at] == seen)
        linked = 100 * hits >= percent * (len(items) + sizes[seen] - hits)
        for other, its in zip(ids[seen[linked]].tolist(), labels[seen[linked]].tolist(), strict=True):
            x, y = top(int(label[q])), top(its)
            if x != y:
                tops[max(x, y)] = min(x, y)
                out.append((int(rep[q]), other))
    return out


def link_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, percent: int = PERCENT, extra: float = EXTRA) -> DataFrame:
    """``(id, n, component)`` for each row: set size and the smallest id that links reach."""
    docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    whole_marks = saved(signed(docs, size, percent, extra), "jaccard-marks")
    known = whole_marks.where("id is not null and n > 0")
    reps = saved(known.groupBy("sig").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "jaccard-reps")
    marks = saved(whole_marks.select("id", "n", "sig"), "jaccard-marks")
    least_k = F.greatest(F.lit(1), F.floor(F.col("n") * extra))
    some = shared_items(reps, "prefix").join(reps.select("rep", "sig", "n"), "rep").where(F.col("shared") >= least_k)
    some = saved(some.select(F.col("rep").alias("id"), F.col("sig").alias("want")), "jaccard-some")
    classes = saved(reps.select("sig", "rep"), "jaccard-classes")
    discard(whole_marks, reps)

    def whole(b):
        sets = [shingles(t, size) for t in texts(b, "text")]
        return {"sig": pa.array([_signature(s) for s in sets], pa.binary()), "items": _lists(sets)}

    sets = map_batches(_semi(docs, some, ["id"]), whole, [("sig", "binary"), ("items", "array<bigint>")], ["id", "want"])
    sets = sets.where("sig = want").select(F.col("id").alias("rep"), F.size("items").cast("bigint").alias("n"), "items").dropDuplicates(["rep"])
    sets = saved(sets, "jaccard-sets")
    need = F.ceil(F.col("n") * percent / 100)
    kept = shared_items(sets, "items").join(sets, "rep").where(F.col("shared") >= need)
    kept = saved(kept.select("rep", "n", "items"), "jaccard-kept")
    discard(some, sets)
    # rarest first among what is left
    rows = kept.select("rep", "n", F.explode("items").alias("item"))
    df_of = rows.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    rows = saved(rows.join(df_of, "item"), "jaccard-lists")
    order = W.partitionBy("rep").orderBy("df", "item")
    sums = rows.groupBy("rep").agg(F.count("*").alias("common"), F.sum("df").alias("weight"))
    first = rows.withColumn("place", F.row_number().over(order)).join(sums, "rep")
    first = first.where(F.col("place") <= F.col("n") - need + 1 - (F.col("n") - F.col("common"))).select("rep", "item", "weight")
    # shingles with the same owners are one list
    h = F.xxhash64("rep")
    heads = first.groupBy("item").agg(F.max(F.struct("weight", "rep")).alias("pivot"), F.count("*").alias("m"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("y")).where("m > 1")
    heads = heads.select("item", "pivot", F.xxhash64("pivot", "m", "x", "y").alias("list"))
    owners = saved(first.join(heads, "item").select("list", "rep", "pivot").distinct(), "jaccard-owners")
    discard(rows)
    # each set against one pivot
    pairs = owners.groupBy("rep").agg(F.max("pivot").alias("pivot")).select(F.col("rep").alias("a"), F.col("pivot.rep").alias("b")).where("a <> b")
    left = kept.withColumnRenamed("rep", "a").join(pairs, "a")
    right = kept.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("items").alias("mid"))
    both = F.size(F.array_intersect("items", "mid"))
    linked = 100 * both >= percent * (F.col("n") + F.col("nb") - both)
    near = saved(left.join(right, "b").where(linked).select("a", "b"), "jaccard-near")
    labels = components(near)
    # lists whose owners are not all connected yet
    owners = owners.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("list", "rep", F.coalesce("component", "rep").alias("label"), (F.col("pivot.rep") == F.col("rep")).alias("heads"))
    owners = saved(owners, "jaccard-labelled")
    home = owners.groupBy("list").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.when(F.col("heads"), F.col("label"))).alias("home"), F.min("rep").alias("first")).where("lo < hi").select("list", "home", "first")
    apart = saved(owners.join(home, "list").select("rep", "first", "label", (F.col("label") != F.col("home")).alias("asking")), "jaccard-apart")
    # such lists are searched together if they have an owner in common, so that a set travels once
    groups = components(apart.select(F.col("rep").alias("a"), F.col("first").alias("b"))).select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    ready = apart.groupBy("rep").agg(F.max("label").alias("label"), F.max("asking").alias("asking")).join(groups, "rep")
    ready = saved(ready.join(kept, "rep"), "jaccard-open")
    load = ready.groupBy("grp").agg(F.ceil(F.sum(F.when(F.col("asking"), F.col("n"))) / QUERY_ITEMS).cast("int").alias("qs"), F.ceil(F.sum("n") / INDEX_ITEMS).cast("int").alias("ms"))
    ready = ready.join(load, "grp")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    mine = lambda k: F.pmod(F.xxhash64("rep"), F.col(k)).cast("int")
    cols = ["rep", "label", "items"]
    queries = ready.where("asking").select("grp", mine("qs").alias("qb"), every("ms").alias("mb"), F.lit(True).alias("asks"), *cols)
    held = ready.select("grp", every("qs").alias("qb"), mine("ms").alias("mb"), F.lit(False).alias("asks"), *cols)
    more = saved(queries.unionByName(held).groupBy("grp", "qb", "mb").applyInArrow(_search(percent), "a bigint, b bigint"), "jaccard-more")
    comp = components(near.unionByName(more))
    found = classes.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    found = found.select("sig", F.coalesce("component", "rep").alias("component"))
    out = marks.select("id", "n", "sig").join(found, "sig", "left")
    return out.select("id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows whose id names their component; rows with a null id stay."""
    comp = link_components(df, id_col, text_col, **how)
    keep = saved(comp.where("id = component").select(F.col("id").alias(KEPT_ID)).distinct(), "jaccard-keep")
    few = keep.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    names = [f"c{i}" for i in range(len(df.columns))]
    key = F.col(names[df.columns.index(id_col)])
    found = df.toDF(*names).join(F.broadcast(keep) if few else keep, key == F.col(KEPT_ID), "left")
    return found.where(key.isNull() | F.col(KEPT_ID).isNotNull()).select(*names).toDF(*df.columns)
