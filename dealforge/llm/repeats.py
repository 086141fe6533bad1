"""Removal of repeated byte strings by sampled suffixes.

A byte goes if some string of ``LENGTH`` bytes over it also starts anywhere else in the corpus, in
the same text included.

The plan is that of difference-cover suffix sorting, a sample of suffixes named first and the rest
settled through it, with one change: the sample is chosen by content instead of by residue. A
position is sampled if its ``GRAM``-byte string has the least hash of all that start in some window
of ``LENGTH`` bytes, so equal strings hold equal samples at equal places. With residues every suffix
of the corpus would pass through each round of sorting; with content only strings around a sample
whose name occurs twice do.

1. Equal texts become one; copies of at least ``LENGTH`` bytes go whole.
2. Sampled strings get a hash as name; names that occur twice or more go back to their texts.
3. Around samples whose name recurs, the strings of ``LENGTH`` bytes that the sample governs go, as
   one block of bytes, to the part of their name. A name with more than ``HOT`` samples has its
   strings dealt out one by one by their own hash instead, so no part gets a whole hot group.
4. In each part the strings are sorted by their hash and adjacent ones compared.

Two strings count as equal if 64-bit hashes of both the strings and, in blocks, their samples agree.

Cases: texts are read whole whatever their length; columns besides id and text are not carried,
whatever their names; ties do not matter, as every equal string counts; a null text is empty and
loses nothing, nor do texts shorter than ``LENGTH``; repeated rows
are copies of each other; a null id is carried through; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, mix64, pieces, saved, texts
from .wordhash import FIRST

LENGTH = 400
GRAM = 32
HOT = 256
#: Share of all samples from which a name is looked up apart.
HOT_SHARE = 1e-4
#: Texts with copies that may be broadcast, two numbers each; more are joined by a shuffle.
BROADCAST_TEXTS = 200_000
CHUNK = 1 << 16


def string_hashes(b: np.ndarray, length: int) -> np.ndarray:
    """The hash of each string of ``length`` bytes.

    Eight bytes are mixed as one number, then the hashes of two halves, which may overlap, are mixed
    into that of a longer string. So there are no fixed patterns of differences under which strings
    are equal, as under a polynomial modulo a power of two.
    """
    n = len(b) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for i in range(0, n, CHUNK):
        part = b[i : i + CHUNK + length - 1]
        size = min(8, length)
        padded = np.concatenate([part, np.zeros(7, np.uint8)])
        h = mix64(np.ndarray(len(part) - size + 1, "<u8", padded, strides=(1,)) & FIRST[size])
        while size < length:
            step = min(size, length - size)
            h = mix64(mix64(h[:-step]) + h[step:])
            size += step
        out[i : i + CHUNK] = h
    return out


def sampled(b: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples of a text of at least ``length`` bytes: place, name, and first string governed.

    The strings from one sample's first to the next's are those in which it is the leftmost least.
    """
    h = string_hashes(b, gram)
    w = length - gram + 1
    n = len(h) - w + 1
    # least hash of each window, by running minima to the left and right within blocks of w
    pad = -len(h) % w
    grid = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    left = np.minimum.accumulate(grid, 1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(right[:n], left[w - 1 : w - 1 + n])
    # a run of equal minima is one sample, unless its place leaves the window
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    starts = np.concatenate([[0], change])
    ends = np.concatenate([change, [n]])
    place, name, first = [], [], []
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    lo = np.searchsorted(ranked, least[starts])
    hi = np.searchsorted(ranked, least[starts], "right")
    one = hi - lo == 1
    if one.all():
        return order[lo], least[starts], starts
    for s, e, a, z in zip(starts.tolist(), ends.tolist(), lo.tolist(), hi.tolist(), strict=True):
        spots = np.sort(order[a:z])
        p = s
        while p < e:  # leftmost place in the window that starts at p, for as long as it stays inside
            m = int(spots[np.searchsorted(spots, p)])
            place.append(m)
            name.append(int(h[m]))
            first.append(p)
            p = m + 1
    return np.array(place), np.array(name, np.uint64), np.array(first)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def _cut(part: np.ndarray, parts: int, *cols: np.ndarray):
    by = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[by], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(ends))
    return full, [[c[ends[p] : ends[p + 1]].tobytes() for p in full] for c in (x[by] for x in cols)]


def _parts(df: DataFrame) -> tuple[int, int]:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return n, 4 * max(16, n)


def recurring(names: DataFrame) -> DataFrame:
    """``(name, n)`` of those among the arrays ``names`` that occur twice or more."""
    return names.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def shared_names(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """``(tid, shared)``: the recurring names of each text that has some, with their counts.

    Names of at least ``HOT_SHARE`` of all samples, at most ``1 / HOT_SHARE`` of them, are broadcast;
    the others meet their texts by a shuffle.
    """
    samples = classes.agg(F.sum(F.size("names"))).first()[0] or 0
    often = F.col("n") >= max(2, HOT_SHARE * samples)
    names = classes.select("tid", F.explode("names").alias("name")).join(F.broadcast(shared.where(often)), "name", "left")
    rest = names.where("n is null").drop("n").join(shared.where(~often), "name")
    return names.where("n is not null").unionByName(rest).groupBy("tid").agg(F.collect_set(F.struct("name", "n")).alias("shared"))


#: A packed row holds either blocks or single strings. Blocks: the sample's name, text, place of
#: the first string, number of bytes; then all their bytes. Strings: hash, text, place.
BLOCKS = "part int, names binary, tids binary, firsts binary, sizes binary, bytes binary"


def _spread(parts: int, length: int, gram: int, hot: int):
    """Blocks and strings of texts around their recurring names (column ``shared``)."""

    def run(batches):
        for b in pieces(batches):
            blocks, strings = [], []
            for i, text in enumerate(texts(b, "text")):
                raw = _bytes(text)
                if len(raw) < length:
                    continue
                got = b.column("shared")[i].as_py()
                names, counts = np.array([x["name"] for x in got], np.int64), np.array([x["n"] for x in got], np.int64)
                by = np.argsort(names)
                names, counts = names[by], counts[by]
                place, name, first = sampled(raw, length, gram)
                name = name.view(np.int64)
                at = np.minimum(np.searchsorted(names, name), len(names) - 1)
                known = names[at] == name
                if not known.any():
                    continue
                last = np.append(first[1:], len(raw) - length + 1)  # one past the last string
                tid = b.column("tid")[i].as_py()
                often = known & (counts[at] > hot)
                for j in np.flatnonzero(known & ~often):
                    blocks.append((name[j], tid, first[j], raw[first[j] : last[j] + length - 1]))
                if often.any():
                    h = string_hashes(raw, length).view(np.int64)
                    pos = np.concatenate([np.arange(first[j], last[j]) for j in np.flatnonzero(often)])
                    strings.append((h[pos], np.full(len(pos), tid), pos))
            if blocks:
                name = np.array([x[0] for x in blocks], np.int64)
                part = (mix64(name.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
                by = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[by], np.arange(parts + 1))
                full = np.flatnonzero(np.diff(ends))
                rows = [by[ends[p] : ends[p + 1]] for p in full]
                col = lambda k: [np.array([blocks[j][k] for j in r], np.int64).tobytes() for r in rows]
                size = [np.array([len(blocks[j][3]) for j in r], np.int64).tobytes() for r in rows]
                data = [np.concatenate([blocks[j][3] for j in r]).tobytes() for r in rows]
                yield _record(full, col(0), col(1), col(2), size, data)
            if strings:
                h, tid, pos = (np.concatenate(x) for x in zip(*strings, strict=True))
                full, cut = _cut((mix64(h.view(np.uint64) ^ np.uint64(9)) % np.uint64(parts)).astype(np.int64), parts, h, tid, pos.astype(np.int32))
                yield _record(full, *cut, None, None)

    return run


def _record(full, names, tids, firsts, sizes, data) -> pa.RecordBatch:
    none = pa.nulls(len(full), pa.binary())
    cols = [none if c is None else pa.array(c, pa.binary()) for c in (names, tids, firsts, sizes, data)]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *cols], names=[x.split()[0] for x in BLOCKS.split(", ")])


def _settle(length: int):
    """Byte ranges covered by strings that have an equal in their part."""

    def run(batches):
        hs, names, tids, firsts = [], [], [], []
        for b in batches:
            for name, tid, first, size, data in zip(*(b.column(c).to_pylist() for c in ("names", "tids", "firsts", "sizes", "bytes")), strict=True):
                if data is None:
                    h = np.frombuffer(name, np.int64)
                    hs.append(h)
                    names.append(np.zeros(len(h), np.int64))
                    tids.append(np.frombuffer(tid, np.int64))
                    firsts.append(np.frombuffer(first, np.int32))
                    continue
                raw, sizes = np.frombuffer(data, np.uint8), np.frombuffer(size, np.int64)
                ends = np.cumsum(sizes)
                keep = np.ones(max(0, len(raw) - length + 1), bool)
                for e in ends[:-1]:  # strings that reach into the next block
                    keep[max(0, e - length + 1) : e] = False
                hs.append(string_hashes(raw, length).view(np.int64)[keep])
                k = sizes - length + 1
                names.append(np.repeat(np.frombuffer(name, np.int64), k))
                tids.append(np.repeat(np.frombuffer(tid, np.int64), k))
                firsts.append((np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(np.frombuffer(first, np.int64), k)).astype(np.int32))
        if not hs:
            return
        h, name, tid, pos = (np.concatenate(x) for x in (hs, names, tids, firsts))
        del hs, names, tids, firsts
        by = np.argsort(h)
        same = (h[by][1:] == h[by][:-1]) & (name[by][1:] == name[by][:-1])
        twice = np.zeros(len(h), bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        tid, pos = tid[twice], pos[twice]
        if not len(tid):
            return
        by = np.lexsort((pos, tid))
        tid, pos = tid[by], pos[by]
        new = np.concatenate([[True], (tid[1:] != tid[:-1]) | (pos[1:] > pos[:-1] + length)])
        at = np.flatnonzero(new)
        ends = pos[np.append(at[1:] - 1, len(pos) - 1)] + length
        for i in range(0, len(at), 100_000):
            j = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(tid[at[j]]), pa.array(pos[at[j]].astype(np.int64)), pa.array(ends[j].astype(np.int64))], names=["tid", "start", "end"])

    return run


def repeated_ranges(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``(tid, whole, ranges)`` of texts that lose bytes; ``tid`` is ``text_key`` of the text.

    ``whole`` texts go entirely. ``ranges`` may overlap.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).where(F.octet_length("text") >= length).withColumn("tid", text_key())

    def name(b):
        got = [sampled(_bytes(t), length, gram)[1].view(np.int64) for t in texts(b, "text")]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
        return {"names": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got) if got else np.zeros(0, np.int64)))}

    marks = saved(map_batches(docs, name, [("names", "array<bigint>")], ["id", "tid"]), "repeats-samples")
    classes = saved(marks.groupBy("tid").agg(F.count("*").alias("copies"), F.min("id").alias("first"), F.first("names").alias("names")), "repeats-classes")
    shared = saved(recurring(classes), "repeats-names")
    n_parts, parts = _parts(df)
    copies = saved(classes.where("copies > 1").select(F.col("tid").alias("ctid"), "first"), "repeats-copies")
    few = copies.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
    lone = docs.join(F.broadcast(copies) if few else copies, F.col("tid") == F.col("ctid"), "left")
    lone = lone.where(F.col("ctid").isNull() | F.col("id").eqNullSafe(F.col("first"))).select("tid", "text")
    lone = lone.join(shared_names(classes, shared), "tid")
    spread = lone.mapInArrow(_spread(parts, length, gram, hot), BLOCKS).repartition(n_parts, "part")
    ranges = spread.mapInArrow(_settle(length), "tid bigint, start bigint, end bigint")
    ranges = ranges.groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    ranges = ranges.join(copies.select(F.col("ctid").alias("tid"), F.lit(True).alias("whole")), "tid", "full")
    return ranges.select("tid", F.coalesce("whole", F.lit(False)).alias("whole"), F.when(F.col("whole").isNull(), F.col("ranges")).alias("ranges"))


def text_key():
    return F.xxhash64("text", F.octet_length("text"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept)`` for each row; ``kept`` holds the bytes that stay."""
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("tid", text_key())
    found = saved(repeated_ranges(df, id_col, text_col, **how), "repeats-ranges")
    rows = docs.join(found.hint("merge"), "tid", "left")  # ranges have no bound, so never broadcast
    rows = rows.select("id", "text", "whole", "ranges")

    def cut(b):
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, whole, ranges in zip(texts(b, "text"), b.column("whole").to_pylist(), b.column("ranges").to_pylist(), strict=True):
            raw = text.encode()
            spans = [(0, len(raw))] if whole else _merge(ranges or [])
            at, rest = 0, []
            for s, e in spans:
                rest.append(raw[at:s])
                at = e
            rest.append(raw[at:])
            kept.append(b"".join(rest))
            n_bytes.append(len(raw))
            n_removed.append(len(raw) - len(kept[-1]))
            n_spans.append(len(spans))
        return {"n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())}

    return map_batches(rows, cut, [("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept", "binary")], ["id"])


def _merge(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((r["start"], r["end"]) for r in ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out
