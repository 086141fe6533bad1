"""Brown class-based n-grams: exchange clustering, then smoothed class transitions and emissions.

Tokens are a text's words, A-Z lower-cased, and one end. Words that make up ``KNOWN_SHARE`` of the
training tokens are units of their own; all others form units by length and last byte. Exchange
clustering moves units between classes as long as the likelihood of class bigrams rises: first
those of at least ``UNIT_SHARE`` and the shapes, in sweeps over their bigrams; then each other word
once, in Spark, by the counts of its neighbours' classes. A token's probability is that of its class
after the last token's class, times the unit's within the class, times, in a shape, the word's.

Counts cover all training texts and are held in tables keyed by 64-bit word hashes. Counts and
classes of units (at most ``1 / KNOWN_SHARE`` words) are broadcast; the counts of rarer words meet
the texts that hold them in packed blocks dealt out by hash. Bigrams that reach the driver are
bounded by ``1 / UNIT_SHARE`` words and ``SHAPES``, squared; neighbours' classes stay in Spark.

Cases: a null or empty text is an end alone; texts are read whole whatever their length; units of
equal weight start in the order of their numbers, so reruns agree; columns besides id and text are
not carried, whatever their names; a null id takes part in scoring and is held out;
repeated rows are scored each and train each; empty tables, or nothing to train on, give scores by
smoothing alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from .common import give_back, mix64, pieces, saved, small_batches, texts
from .wordhash import word_hashes

UNIT_SHARE = 1e-4
#: At most ``UNIT_SHARE``.
KNOWN_SHARE = 5e-7
CLASSES = 48
SWEEPS = 8
ADD = 0.1
#: Pseudo-count of the class unigram behind a class transition.
BACK = 5.0
LENGTHS = 16
SHAPES = LENGTHS * 256
END = np.uint64(0xE17D0C5)  # the end's own hash
END_SHAPE = 0
#: Tokens that a task counts at once.
CHUNK = 2_000_000


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def tokens(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and shape of each token; the last is the end."""
    h, size, last = word_hashes(text)
    shape = np.minimum(size, LENGTHS - 1) * 256 + last
    return np.append(h, END), np.append(shape, END_SHAPE)


def word_counts(train: DataFrame) -> DataFrame:
    """``(h, shape, n)`` over all texts of ``train``."""

    def counted(hs, shapes):
        u, at, n = np.unique(np.concatenate(hs), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.concatenate(shapes)[at].astype(np.int32)), pa.array(n)], names=["h", "shape", "n"])

    def run(batches):
        hs, shapes, held = [], [], 0
        for b in batches:
            for t in texts(b, "text"):
                h, s = tokens(t)
                hs.append(h)
                shapes.append(s)
                held += len(h)
                if held > CHUNK:
                    yield counted(hs, shapes)
                    hs, shapes, held = [], [], 0
        if hs:
            yield counted(hs, shapes)
        give_back()

    rows = small_batches(train).select("text").mapInArrow(run, "h bigint, shape int, n bigint")
    return rows.groupBy("h").agg(F.first("shape").alias("shape"), F.sum("n").alias("n"))


class Units:
    """Hash or shape of a token -> unit number."""

    def __init__(self, own: np.ndarray):
        self.own = np.sort(own.astype(np.uint64))
        self.count = SHAPES + len(own)

    def of(self, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        if not len(self.own):
            return shape.astype(np.int64)
        at = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
        return np.where(self.own[at] == h, SHAPES + at, shape)


def unit_bigrams(train: DataFrame, units: Units) -> DataFrame:
    """``(pair, n)``: counts of adjacent units, the first times ``units.count`` plus the second."""
    shared = train.sparkSession.sparkContext.broadcast(units)

    def counted(pairs):
        p, n = np.unique(np.concatenate(pairs), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(p), pa.array(n)], names=["pair", "n"])

    def run(batches):
        u, pairs, held = shared.value, [], 0
        for b in batches:
            for t in texts(b, "text"):
                seq = u.of(*tokens(t))
                pairs.append(np.concatenate([seq[-1:], seq[:-1]]) * u.count + seq)
                held += len(seq)
                if held > CHUNK:
                    yield counted(pairs)
                    pairs, held = [], 0
        if pairs:
            yield counted(pairs)
        give_back()

    return train.select("text").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def gains(table: np.ndarray, right: np.ndarray, left: np.ndarray, own: float) -> np.ndarray:
    """What the log likelihood of ``table`` gains if a unit joins each of the classes.

    ``table`` lacks the unit, ``right`` and ``left`` count the classes after and before it, ``own``
    the unit after itself.
    """
    diag = np.diag(table)
    gain = (_xlogx(table + right) - _xlogx(table)).sum(1) + (_xlogx(table + left[:, None]) - _xlogx(table)).sum(0)
    gain += _xlogx(diag + right + left + own) - _xlogx(diag + right) - _xlogx(diag + left) + _xlogx(diag)
    # whatever class the unit joins, its neighbours' rows and columns hold the bigrams with it
    rows, cols = table.sum(1) + left, table.sum(0) + right
    return gain - (_xlogx(rows + right.sum() + own) - _xlogx(rows) + _xlogx(cols + left.sum() + own) - _xlogx(cols))


def _move(table: np.ndarray, cls: int, right: np.ndarray, left: np.ndarray, own: float, sign: int) -> None:
    """Add a unit's bigrams to a class, or take them from it."""
    table[cls] += sign * right
    table[:, cls] += sign * left
    table[cls, cls] += sign * own


def best_class(table: np.ndarray, old: int, right: np.ndarray, left: np.ndarray, own: float) -> int:
    """The class that gains most; ``table`` lacks the unit, which stays in ``old`` on a tie."""
    gain = gains(table, right, left, own)
    new = int(gain.argmax())
    return old if gain[new] <= gain[old] + 1e-9 else new


def exchange(first: np.ndarray, second: np.ndarray, n: np.ndarray, classes: int, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit and the class bigram counts, by exchange clustering.

    ``first``, ``second`` and ``n`` are the unit bigrams, units numbered from 0. The commonest
    units start in classes of their own, the others share the last.
    """
    count = int(max(first.max(), second.max())) + 1
    weight = np.bincount(second, n, count)
    order = np.argsort(-weight, kind="stable")
    cls = np.full(count, classes - 1)
    cls[order[: classes - 1]] = np.arange(min(classes - 1, count))
    f1, s1 = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    after = np.searchsorted(first[f1], np.arange(count + 1))
    before = np.searchsorted(second[s1], np.arange(count + 1))
    table = np.zeros((classes, classes))
    np.add.at(table, (cls[first], cls[second]), n)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            a, p = f1[after[u] : after[u + 1]], s1[before[u] : before[u + 1]]
            nxt, prv = second[a], first[p]
            own = n[a][nxt == u].sum()
            right = np.bincount(cls[nxt[nxt != u]], n[a][nxt != u], classes)
            left = np.bincount(cls[prv[prv != u]], n[p][prv != u], classes)
            if not (own or right.any() or left.any()):
                continue
            old = cls[u]
            _move(table, old, right, left, own, -1)
            new = cls[u] = best_class(table, old, right, left, own)
            _move(table, new, right, left, own, 1)
            moved += new != old
        if not moved:
            break
    return cls, table


def cluster(units: Units, pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit and the class bigrams, from ``unit_bigrams``; unseen units share the last class."""
    cls = np.full(units.count, CLASSES - 1)
    table = np.zeros((CLASSES, CLASSES))
    if len(pairs):
        used = np.unique(np.concatenate([pairs // units.count, pairs % units.count]))
        first, second = np.searchsorted(used, pairs // units.count), np.searchsorted(used, pairs % units.count)
        cls[used], table = exchange(first, second, n.astype(float), CLASSES)
    return cls, table


def place(train: DataFrame, units: Units, cls: np.ndarray, loose: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``cls`` after each unit in ``loose`` joined the class that gains most, the others staying.

    A task counts the classes beside each loose unit; the counts of a unit meet in one part.
    ``table`` holds the class bigrams under ``cls``.
    """
    spark = train.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 2 * max(16, n_parts)
    slots = CLASSES + 1  # the last for the unit itself
    number = np.where(loose, np.cumsum(loose) - 1, -1).astype(np.int32)
    shared = spark.sparkContext.broadcast((units, cls.astype(np.int16), number, cls[loose].astype(np.int16), table))

    def counted(keys):
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        full, cut = _pack(key // (2 * slots) % parts, parts, key.astype(np.int32), n.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.array(c, pa.binary()) for c in cut]], names=["part", "keys", "ns"])

    def beside(batches):
        units, cls, number, _, _ = shared.value
        keys, held = [], 0
        for b in batches:
            for t in texts(b, "text"):
                u = units.of(*tokens(t))
                before = np.concatenate([u[-1:], u[:-1]])
                for side, (me, other) in enumerate(((before, u), (u, before))):
                    at = np.flatnonzero(number[me] >= 0)
                    me, other = me[at], other[at]
                    keys.append((number[me].astype(np.int64) * 2 + side) * slots + np.where(me == other, CLASSES, cls[other]))
                    held += len(at)
                if held > CHUNK:
                    yield counted(keys)
                    keys, held = [], 0
        if held:
            yield counted(keys)
        give_back()

    def choose(batches):
        _, _, _, old, table = shared.value
        got = [(np.frombuffer(k, np.int32), np.frombuffer(n, np.int32)) for b in batches for k, n in zip(b.column("keys").to_pylist(), b.column("ns").to_pylist(), strict=True)]
        if not got:
            return
        key, n = _sums(*(np.concatenate(x) for x in zip(*got, strict=True)))
        unit, start = np.unique(key // (2 * slots), return_index=True)
        new = np.empty(len(unit), np.int16)
        for i, (a, z) in enumerate(zip(start, np.append(start[1:], len(key)), strict=True)):
            sides = np.bincount(key[a:z] % (2 * slots), n[a:z], 2 * slots)
            right, own, left = sides[:CLASSES], sides[CLASSES], sides[slots : slots + CLASSES]
            rest = table.copy()
            _move(rest, old[unit[i]], right, left, own, -1)
            new[i] = best_class(rest, old[unit[i]], right, left, own)
        for i in range(0, len(unit), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(unit[i : i + 100_000].astype(np.int64)), pa.array(new[i : i + 100_000])], names=["number", "cls"])

    counts = small_batches(train).select("text").mapInArrow(beside, "part int, keys binary, ns binary")
    got = counts.repartition(n_parts, "part").mapInArrow(choose, "number bigint, cls smallint").toPandas()
    out = cls.copy()
    out[np.flatnonzero(loose)[got["number"].to_numpy(np.int64)]] = got["cls"].to_numpy(np.int64)
    return out


def class_bigrams(train: DataFrame, units: Units, cls: np.ndarray) -> np.ndarray:
    """Counts of adjacent classes over all texts of ``train``."""
    shared = train.sparkSession.sparkContext.broadcast((units, cls.astype(np.int16)))

    def run(batches):
        units, cls = shared.value
        n = np.zeros(CLASSES * CLASSES, np.int64)
        for b in batches:
            for t in texts(b, "text"):
                c = cls[units.of(*tokens(t))].astype(np.int64)
                n += np.bincount(np.concatenate([c[-1:], c[:-1]]) * CLASSES + c, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["pair", "n"])
        give_back()

    got = small_batches(train).select("text").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    return np.bincount(got["pair"].to_numpy(np.int64), got["n"].to_numpy(float), CLASSES * CLASSES).reshape(CLASSES, CLASSES)


class Model:
    """What scoring needs on every executor; its size is bounded by the shares above.

    ``known`` are the counts of ``units.own``, ``per_shape`` the tokens and distinct words of each
    shape that have no unit of their own.
    """

    def __init__(self, units: Units, cls: np.ndarray, table: np.ndarray, known: np.ndarray, per_shape: np.ndarray, total: int, distinct: int):
        self.units, self.cls, self.known, self.total, self.distinct = units, cls.astype(np.int16), known, total, distinct
        size = table.sum(0)
        back = (size + 1) / (size.sum() + CLASSES)
        self.move = np.log10((table + BACK * back) / (table.sum(1, keepdims=True) + BACK))
        # units that training never saw are members too, so a class's units sum to one
        members = np.bincount(cls, minlength=CLASSES)
        self.emit = np.log10((np.concatenate([per_shape[:, 0], known]) + ADD) / (size + ADD * members)[cls])
        self.shape_n, self.shape_v = per_shape[:, 0], per_shape[:, 1]

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + ADD) / (self.total + ADD * (self.distinct + 1)))

    def within(self, n: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Log probability of a word among those of its shape."""
        return np.log10((n + ADD) / (self.shape_n[shape] + ADD * (self.shape_v[shape] + 1)))


def fit(docs: DataFrame, counts: DataFrame) -> Model:
    """Train on the rows of ``docs`` (column ``text``) whose word counts are ``counts``."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    known = counts.where(F.col("n") >= KNOWN_SHARE * total).toPandas()
    h, shape, n = known["h"].to_numpy(np.int64).view(np.uint64), known["shape"].to_numpy(np.int64), known["n"].to_numpy(np.int64)
    by = np.argsort(h)
    h, shape, n = h[by], shape[by], n[by]
    rare = counts.where(F.col("n") < KNOWN_SHARE * total).groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    per_shape = np.zeros((SHAPES, 2))
    per_shape[rare["shape"].to_numpy(np.int64)] = rare[["n", "v"]].to_numpy(float)
    common = n >= UNIT_SHARE * total
    core, units = Units(h[common]), Units(h)
    pairs = unit_bigrams(docs, core).toPandas()
    cls, table = cluster(core, pairs["pair"].to_numpy(np.int64), pairs["n"].to_numpy(np.int64))
    cls = np.concatenate([cls[:SHAPES], cls[core.of(h, shape)]])
    loose = np.concatenate([np.zeros(SHAPES, bool), ~common])
    if loose.any():
        cls = place(docs, units, cls, loose, table)
        table = class_bigrams(docs, units, cls)
    return Model(units, cls, table, n, per_shape, int(total), int(distinct))


def _pack(part: np.ndarray, parts: int, *cols: np.ndarray):
    """The numbers of the blocks that have rows, and each column cut into those blocks."""
    by = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[by], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(ends))
    return full, [[c[ends[p] : ends[p + 1]].tobytes() for p in full] for c in (x[by] for x in cols)]


def _sums(key: np.ndarray, *cols: np.ndarray) -> list[np.ndarray]:
    """The distinct keys and each column's sums by key."""
    one, at = np.unique(key, return_inverse=True)
    return [one, *[np.bincount(at, c, len(one)) for c in cols]]


ROWS = "part int, row bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, ids binary, hs binary, ns binary, shapes binary"


def score(docs: DataFrame, counts: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, base_score, score)`` for each row of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 2 * max(16, n_parts)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        task, rows = TaskContext.get().partitionId(), 0
        for b in pieces(batches):
            m = shared.value
            base, got, known_n, token_n, rare = [], [], [], [], []
            for i, t in enumerate(texts(b, "text")):
                h, shape = tokens(t)
                u = m.units.of(h, shape)
                c = m.cls[u]
                s = m.move[np.concatenate([c[-1:], c[:-1]]), c].sum() + m.emit[u].sum()
                hit = u >= SHAPES
                n = m.known[u[hit] - SHAPES]
                base.append(m.base(n).sum())
                got.append(s)
                known_n.append(len(n))
                token_n.append(len(h))
                if not hit.all():
                    rare.append((np.full((~hit).sum(), rows + i), h[~hit], shape[~hit]))
            ids = np.arange(rows, rows + b.num_rows) + (task << 40)
            rows += b.num_rows
            none = lambda k, t: pa.nulls(k, t)
            k = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [none(k, pa.int32()), pa.array(ids), b.column("held_out"), pa.array(token_n, pa.int64()), pa.array(known_n, pa.int64()), pa.array(base, pa.float64()), pa.array(got, pa.float64()), *[none(k, pa.binary())] * 4, b.column(id_col)], names=[*names, id_col]
            )
            if rare:
                row, h, shape = (np.concatenate(x) for x in zip(*rare, strict=True))
                key = mix64(h ^ np.uint64(5))
                full, cut = _pack((key % np.uint64(parts)).astype(np.int64), parts, row + (task << 40), h, shape.astype(np.int16))
                k = len(full)
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[none(k, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], pa.array(cut[0], pa.binary()), pa.array(cut[1], pa.binary()), none(k, pa.binary()), pa.array(cut[2], pa.binary()), none(k, b.column(id_col).type)], names=[*names, id_col])

    names = [x.split()[0] for x in ROWS.split(", ")]
    out = saved(small_batches(docs).select(id_col, "text", "held_out").mapInArrow(run, f"{ROWS}, `{id_col}` {id_type}"), "brown-rows")

    def file(batches):
        for b in batches:
            h = b.column("h").to_numpy().view(np.uint64)
            full, cut = _pack((mix64(h ^ np.uint64(5)) % np.uint64(parts)).astype(np.int64), parts, h, b.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.nulls(len(full), pa.binary()), pa.array(cut[0], pa.binary()), pa.array(cut[1], pa.binary()), pa.nulls(len(full), pa.binary())], names=["part", "ids", "hs", "ns", "shapes"])

    def meet(batches):
        m = shared.value
        words, rows = [], []
        for b in batches:
            for ids, hs, ns, shapes in zip(*(b.column(c).to_pylist() for c in ("ids", "hs", "ns", "shapes")), strict=True):
                if ns is not None:
                    words.append((np.frombuffer(hs, np.uint64), np.frombuffer(ns, np.int64)))
                else:
                    rows.append((np.frombuffer(ids, np.int64), np.frombuffer(hs, np.uint64), np.frombuffer(shapes, np.int16)))
        if not rows:
            return
        ids, h, shape = (np.concatenate(x) for x in zip(*rows, strict=True))
        n = np.zeros(len(h), np.int64)
        if words:
            wh, wn = (np.concatenate(x) for x in zip(*words, strict=True))
            by = np.argsort(wh)
            wh, wn = wh[by], wn[by]
            at = np.minimum(np.searchsorted(wh, h), len(wh) - 1)
            n = np.where(wh[at] == h, wn[at], 0)
        row, k, b, s = _sums(ids, n > 0, m.base(n), m.within(n, shape))
        full, cut = _pack((mix64(row.view(np.uint64)) % np.uint64(n_parts)).astype(np.int64), n_parts, row, k, b, s)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.array(c, pa.binary()) for c in cut]], names=["part", "rows", "ks", "bs", "ss"])

    def add(batches):
        got = [[np.frombuffer(x, t) for x, t in zip(row, (np.int64, float, float, float), strict=True)] for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("rows", "ks", "bs", "ss")), strict=True)]
        if not got:
            return
        row, k, b, s = _sums(*(np.concatenate(x) for x in zip(*got, strict=True)))
        for i in range(0, len(row), 100_000):
            j = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(row[j]), pa.array(k[j].astype(np.int64)), pa.array(b[j]), pa.array(s[j])], names=["row", "k", "b", "s"])

    rarer = counts.where(F.col("n") < KNOWN_SHARE * model.total).select("h", "n").mapInArrow(file, "part int, ids binary, hs binary, ns binary, shapes binary")
    packed = out.where("part is not null").select("part", "ids", "hs", "ns", "shapes").unionByName(rarer)
    more = packed.repartition(n_parts, "part").mapInArrow(meet, "part int, rows binary, ks binary, bs binary, ss binary")
    more = more.repartition(n_parts, "part").mapInArrow(add, "row bigint, k bigint, b double, s double")
    rows = out.where("part is null").join(more, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return rows.select(id_col, "held_out", "n_tokens", plus("n_known", "k").alias("n_known"), plus("base", "b").alias("base_score"), plus("score", "s").alias("score"))


def score_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows that are not held out and score all."""
    docs = df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text")).withColumn("held_out", held_out(F.col(id_col)))
    train = docs.where("not held_out")
    counts = saved(word_counts(train), "brown-counts")
    model = fit(train, counts)
    return score(docs, counts, model, id_col).withColumn("train_tokens", F.lit(model.total).cast("bigint"))
