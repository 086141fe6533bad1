"""Conversation repair, the Merkle manifest and sharding against brute force, with their edge cases."""

import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from dealforge.llm import brown, chat, embeddings, merkle, queries, repair, repeats, sharding

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, sha string"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp int, size int"


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_merkle_manifest", "op13_byte_shards"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(f"select {', '.join(df.columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


# 11 ----------------------------------------------------------------------------------------------

BLANKS = " \t\n\x0b\x0c\r"


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def by_hand(rows):
    """The expected row of one conversation's (turn, role, text), by whole letter strings instead of orders."""
    rows = ordered([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows])
    seen, kinds = set(), []
    for _, r, x in rows:
        kinds.append("blank" if not x.strip(BLANKS) else "duplicate" if (r, x) in seen else "truncated" if x.rstrip(BLANKS)[-1] not in ".!?" else "")
        seen.add((r, x))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    count = collections.Counter(kinds)
    best = closed({"": (0, "", ())})
    for (_, r, x), k in zip(rows, kinds, strict=True):
        new = {}
        for said, (c, a, lines) in best.items():
            ways = [(said, c + 3, a + "D", lines)]
            if k not in ("blank", "duplicate"):
                more = k == "truncated"
                ways.append((said + r[:1] if r else said + "?", c + more, a + "K", (*lines, f"{r}:{x}")))
                ways += [(said + role[0], c + 2 + more, a + "R", (*lines, f"{role}:{x}")) for role in ("user", "assistant")]
            for s, *rest in ways:
                s = state(s)
                if s is not None:
                    new[s] = min(new.get(s, (10**9,)), tuple(rest))
        best = closed(new)
    c, a, lines = min(v for s, v in best.items() if s in ("", "ua"))
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, c, a, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def state(said):
    """Initials so far, shortened to what decides how they may go on; None if they may not."""
    return {"": "", "s": "s", "u": "u", "su": "u", "uau": "u", "ua": "ua"}.get(said)


def closed(best):
    for _ in range(3):
        for said, (c, a, lines) in list(best.items()):
            for role in ("user", "assistant"):
                s = state(said + role[0])
                if s is not None:
                    best[s] = min(best.get(s, (10**9,)), (c + 2, a + "I", (*lines, f"{role}:")))
    return best


def test_edits_of_every_short_conversation():
    """All role and fault patterns of up to four rows, halved in every way, against whole strings."""
    for n in range(1, 5):
        for codes in itertools.product(range(9), repeat=n):
            if n == 4 and zlib.crc32(bytes(codes)) % 11:
                continue
            rows = [(i, {0: "system", 1: "user", 2: "assistant", 3: "tool"}.get(c // 2, "user"), "" if c == 8 else f"text {i}" + ("" if c % 2 else ".")) for i, c in enumerate(codes)]
            steps = [repair.step(c, 1) for c in codes]
            end = repair.best_end(repair.forward(steps, repair.entered(0)))
            got = repair.edits(codes, [1] * n, 0, end) + repair.ENDINGS[end][1]
            assert got == by_hand(rows)[6], codes
            twice = [repair.whole(steps[: n // 2]), repair.whole(steps[n // 2 :])]
            assert repair.whole(twice) == repair.whole(steps)


def conversations(seed=5):
    rnd = random.Random(seed)
    text = lambda: rnd.choice(["", " \t", "Fine.", "And so", "Why?", "é!", "Fine.", "no end \n"]) + rnd.choice(["", str(rnd.randint(0, 9)) + "."])
    role = lambda: rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
    rows = []
    for c in range(30):
        for t in range(rnd.randint(1, 12)):
            rows.append((c, rnd.choice([t, t, t, None, t + 3]), role(), rnd.choice([text(), text(), None])))
    rows += [(100, t, role(), text()) for t in range(90)]
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", "Hm."), (101, 4, "user", None), (102, None, None, None), (103, 0, "user", "x" * 70_000 + "."), (103, 1, "assistant", "y" * 70_000)]
    return rows + rows[:20] + [(104, 1, "assistant", "Same.")] * 50


@pytest.mark.parametrize("block", [(1000, 1 << 20, 64), (3, 50, 2), (1, 1, 3)])
def test_repair(spark, block):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x") for r in rows], TURNS).repartition(4)
    groups = collections.defaultdict(list)
    for c, *r in rows:
        groups[c].append(r)
    got = {r[0]: tuple(r[1:]) for r in repair.repair(df, "conv_id", *block).collect()}
    assert got == {c: by_hand(r) for c, r in groups.items()}


def test_damage_and_repair(spark):
    rows = conversations(8)
    df = spark.createDataFrame([(*r, "x") for r in rows], TURNS)
    groups = {c: [] for c, *_ in rows}
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if k == 1:
            x = ""
        if k == 2:
            x = "".join(y for y in x if y not in ".!?")
        groups[c] += [(t, "user" if k == 4 else r, x)] * {0: 0, 3: 2}.get(k, 1)
    got = {r[0]: tuple(r[1:]) for r in repair.repair(repair.damage(df)).collect()}
    assert got == {c: by_hand(r) for c, r in groups.items()}
    assert repair.repair(repair.damage(df.limit(0))).collect() == []


# 12 ----------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Levels of a tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def walk(levels, i, digest):
    """Siblings' digests in order, and what ``digest`` at leaf i leads to."""
    others = []
    for level in levels[:-1]:
        lo = i - i % 3
        run = level[lo : lo + 3]
        others += run[: i % 3] + run[i % 3 + 1 :]
        run[i % 3] = digest
        digest, i = h(*run), i // 3
    return others, digest


def leaf_of(r):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])


def audited(rows, changed):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    groups = collections.defaultdict(list)
    for r in order:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf_of(r) for r in groups[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for s in names:
        for i, r in enumerate(groups[s]):
            a, d = walk(trees[s], i, leaf_of(changed(r)))
            b, d = walk(top, names.index(s), d)
            out.append((r[0], leaf_of(r), trees[s][-1][0], top[-1][0], h(*a, *b), d, d == top[-1][0]))
    return out


@pytest.mark.parametrize("sources", [1, 5, 100])
def test_manifest(spark, sources):
    rnd = random.Random(sources)
    rows = [(rnd.choice([i, i, i, None]) if i % 50 == 0 else i, None if i % 7 == 0 else f"é{i % sources}", rnd.choice(["en", None, ""]), rnd.choice([i, None]), rnd.choice([None, "", "a\nb", "é\n\n", "x" * 30_000])) for i in range(400)]
    rows += rows[:90] * 2 + [(1, "only", None, None, None)]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], DOCS).repartition(3)
    ident = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    now = F.when(ident % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    off = lambda r: (*r[:4], r[4].replace("\n", "")) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r
    got = [tuple(r) for r in merkle.audit(df, {"text": now}).collect()]
    want = audited(rows, off)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    one = [(5, "s", "en", 2, "ab")]
    df = spark.createDataFrame([(*r, "c", 0, 0) for r in one], DOCS)
    assert [tuple(r) for r in merkle.audit(df).collect()] == audited(one, lambda r: r)
    assert merkle.audit(df.limit(0)).collect() == []


def test_proofs_of_asked_leaves_only(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    m = merkle.build(df.select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), merkle.leaf([F.col(c) for c in merkle.FIELDS]).alias("leaf")))
    asked = m.leaves.where("id in (0, 7, 599)").select("grp", "pos", "id", F.col("leaf").alias("claim"))
    got = merkle.prove(m, asked).select("item.id", "leaf", "root", merkle.folded(F.col("item.claim"), F.col("path")).alias("to")).collect()
    want = {r[0]: r for r in audited(rows, lambda r: r)}
    assert {r.id: (r.leaf, r.root, r.to) for r in got} == {i: (want[i][1], want[i][3], want[i][3]) for i in (0, 7, 599)}


# 13 ----------------------------------------------------------------------------------------------


def test_shards(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([i, i, None, 3]), "s", "en", 0, rnd.choice([None, "", "é" * rnd.randint(1, 300), "same text"]), "l", 1, i) for i in range(900)] + [(5000, "s", "en", 0, "z" * 90_000, "l", 1, 1)]
    rows += [(7, "s", "en", 0, "copy", "l", 1, 9)] * 400
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    out = sharding.assign(df, 40).persist()
    assert out.columns == ["doc_id", "source", "lang", "n_chars", "text", "leaf", "grp", "size", "text_crc32", "shard", "slot"]
    got = out.collect()
    size = lambda t: len((t or "").encode()) + 16
    crc = lambda t: zlib.crc32((t or "").encode())
    assert all(r["size"] == size(r.text) and r.text_crc32 == crc(r.text) for r in got)
    order = sorted(((r[0] is not None, r[0] or 0, crc(r[4]), size(r[4])) for r in rows))
    whole, before, want = sum(o[3] for o in order), 0, []
    slots = collections.Counter()
    for o in order:
        shard = (2 * before + o[3]) * 40 // (2 * whole)
        want.append((*o, shard, slots[shard]))
        slots[shard] += 1
        before += o[3]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"], r.shard, r.slot) for r in got) == sorted(want)
    index = {r.shard: r for r in sharding.shard_index(out).collect()}
    assert sum(r.rows for r in index.values()) == len(rows) and sum(r.bytes for r in index.values()) == whole
    assert sharding.assign(df.limit(0)).collect() == []
    out.unpersist()


def test_written_shards(spark, tmp_path):
    rows = [(i, "s", "en", 0, "w " * (i % 50), "l", 1, i) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    sharding.write_shards(df, str(tmp_path / "out"), 7)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.shard, r.slot) for r in got.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in sharding.assign(df, 7).collect())


# 1, 2, 4, 8 --------------------------------------------------------------------------------------


def test_clashing_names_and_empty_tables(spark):
    """Columns named like an operator's own change nothing, and tables without rows give none."""
    docs = spark.createDataFrame([(i, f"text {i % 3} " + "same words here " * 40) for i in range(12)], "doc_id long, text string")
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("id", "n_bytes", "KEPT", "name", "part", "names", "held_out", "score", "h", "n", "lang")])
    same = lambda f, a, b: sorted(map(tuple, f(a).collect()), key=repr) == sorted(map(tuple, f(b).collect()), key=repr)
    assert same(repeats.remove_repeats, docs, clash) and repeats.remove_repeats(docs.limit(0)).count() == 0
    assert same(brown.score_corpus, docs, clash) and brown.score_corpus(docs.limit(0)).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None)], "vec_id long, embedding array<double>")
    named = vectors.select("*", *[F.lit(1).alias(c) for c in ("id", "component", "kept", "n_links", "cell", "x")])
    assert same(embeddings.near_duplicates, vectors, named) and embeddings.near_duplicates(vectors.limit(0)).count() == 0
    turns = spark.createDataFrame([(i, t, "user" if t % 2 == 0 else "assistant", f"{t} {i * (t > 1)}") for i in range(2) for t in range(4)], "pair_id long, turn long, role string, text string")
    more = turns.select("*", *[F.lit(1).alias(c) for c in ("conv", "said", "side", "a", "b", "at", "part", "train")])
    assert same(lambda d: chat.preference_rows(d.where("pair_id = 0"), d.where("pair_id = 1").withColumn("pair_id", F.lit(0).cast("long"))), turns, more)
