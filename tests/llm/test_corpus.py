"""Corpus operators against brute force on small made-up tables, with their edge cases."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealforge.llm import bpe, brown, chat, embeddings, jaccard, language, mixing, pii, quality, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def words_of(t):
    return WORD.findall(t or "")


def made_up(seed=3):
    """Texts with copies, near copies, shared passages, repeats, odd blanks, an empty and a null one."""
    rnd = random.Random(seed)
    syl = ["ba", "ko", "mi", "tu", "re", "é", "ß", "na"]
    word = lambda: "".join(rnd.choices(syl, k=rnd.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n)).capitalize()
    passage = text(120)
    out = [text(rnd.randint(1, 260)) for _ in range(40)]
    out += [f"{text(30)} {passage}\n{text(20)}" for _ in range(5)]
    base = text(150)
    for _ in range(8):
        w = base.split()
        for k in rnd.sample(range(len(w)), rnd.randint(1, 6)):
            w[k] = word()
        out.append(" ".join(w))
    out += [base, base, base.upper(), "", " \t\n", None, "one two", "ONE  two", "x " * 900, (passage + " ") * 3, "a　b c", "tail " + out[3]]
    return [(i, t, rnd.choice(["en", "fr", None]), rnd.choice(["s1", "s1", "s2", "t", None]), len(t or "")) for i, t in enumerate(out)]


ROWS = made_up()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 1 -----------------------------------------------------------------------------------------------


def without_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone, strict=False) if not g)))
    return out


@pytest.mark.parametrize("limits", [{}, {"HOT_SHARE": 0.0}, {"HOT_SHARE": 2.0, "BROADCAST_TEXTS": 0}])
@pytest.mark.parametrize(("length", "gram", "hot"), [(400, 32, 256), (60, 8, 256), (60, 8, 1)])
def test_repeats(docs, monkeypatch, length, gram, hot, limits):
    for k, v in limits.items():
        monkeypatch.setattr(repeats, k, v)
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(docs, length=length, gram=gram, hot=hot).collect()}
    want = without_repeats([r[1] for r in ROWS], length)
    assert got == dict(enumerate(want))
    assert sum(w[1] for w in want) > 0


def test_strings_that_differ_by_a_pattern_stay(spark):
    """The pattern is a multiple of 2 ** 64 under the polynomial that hashed strings before."""
    pattern = np.array([2])
    for k in (1, 2, *range(4, 52, 4)):
        pattern = np.pad(pattern, (0, k)) - np.pad(pattern, (k, 0))
    one = np.full(len(pattern), ord("m"))
    one, other = (bytes(x.astype(np.uint8)).decode() for x in (one, one + pattern))
    rnd = random.Random(5)
    rows = []
    for _ in range(100):
        head, tail = ("".join(rnd.choices("abcdefgh ", k=42)) for _ in range(2))
        rows += [head + one + tail, head + other + tail]
    assert {len(t) for t in rows} == {repeats.LENGTH}
    for hot in (256, 1):
        got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3), hot=hot)
        assert got.where("n_removed > 0 or n_spans > 0").count() == 0


def test_hashes_of_strings_of_any_length():
    b = np.frombuffer(b"abracadabra abracadabra " * 20, np.uint8)
    for length in (1, 3, 8, 9, 16, 17, 60, 400, len(b), len(b) + 1):
        strings = [bytes(b[p : p + length]) for p in range(len(b) - length + 1)]
        h = repeats.string_hashes(b, length)
        assert len(h) == len(strings) and len(set(zip(strings, h, strict=True))) == len(set(strings)) == len(set(h))


def test_n_removed_shows_passages_and_n_bytes_the_length(spark):
    """A passage of 51 words goes from 400 bytes on; the length before removal doesn't show it."""
    rnd = random.Random(8)
    words = lambda n, k: " ".join("".join(rnd.choices("abcdefgh", k=k)) for _ in range(n))
    short, long = words(51, 6), words(51, 8)
    rows = [(0, f"{words(30, 7)} {short}"), (1, f"{words(40, 7)} {short} {words(9, 5)}"), (2, f"{words(30, 7)} {long}"), (3, f"{words(40, 7)} {long} {words(9, 5)}"), (4, words(90, 7))]
    got = {r["id"]: (r["n_bytes"], r["n_removed"] > 0) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(short) < 400 <= len(long)
    assert got == {i: (len(t), i in (2, 3)) for i, t in rows}


@pytest.mark.parametrize(("length", "gone"), [(400, False), (256, True)])
def test_items_of_benchmark_are_shorter_than_400_bytes(spark, length, gone):
    """Items of over 50 words in two texts each stay by the contract's length and go by a shorter one."""
    items = [t for (t,) in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("text").collect() if len(words_of(t)) > 50]
    assert items and all(256 < len(t.encode()) < 400 for t in items)
    rnd = random.Random(9)
    text = lambda t, letters: " ".join(["".join(rnd.choices(letters, k=90)), t, "".join(rnd.choices(letters, k=90))])
    rows = list(enumerate(text(t, letters) for t in items for letters in ("abcd", "efgh")))
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length).collect()
    assert {r["id"]: r["n_removed"] for r in got} == {i: (len(items[i // 2].encode()) + 2) * gone for i, _ in rows}


def test_sampled_strings_hold_equal_samples():
    b = np.frombuffer(("abcdefgh" * 30 + "z" * 300).encode(), np.uint8)
    h = repeats.string_hashes(b, 8)
    place, name, first = repeats.sampled(b, 60, 8)
    last = np.append(first[1:], len(b) - 59)
    for m, n, a, z in zip(place, name, first, last, strict=True):
        for p in range(a, z):
            window = h[p : p + 53]
            assert m == p + int(window.argmin()) and n == window.min()


# 2 -----------------------------------------------------------------------------------------------


def test_brown_scores(docs):
    got = {r["doc_id"]: r for r in brown.score_corpus(docs).collect()}
    toks = {r[0]: words_of(lower(r[1] or "")) + [None] for r in ROWS}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in toks}
    c = collections.Counter(w for i, t in toks.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in toks.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert r["score"] < 0


def train_of(docs):
    train = docs.where(~brown.held_out(F.col("doc_id")))
    return train, brown.word_counts(train)


def test_classes_and_their_units_sum_to_one(docs):
    m = brown.fit(*train_of(docs))
    assert np.allclose((10**m.move).sum(1), 1)
    assert np.allclose(np.bincount(m.cls, 10.0**m.emit)[np.unique(m.cls)], 1)
    assert m.units.count == len(m.cls) == brown.SHAPES + m.distinct  # every trained word has a class
    assert len(np.unique(m.cls[brown.SHAPES :])) > 20


@pytest.mark.parametrize(("unit", "known"), [(1e-4, 5e-7), (0.02, 5e-7), (0.02, 0.005)])
def test_brown_scores_by_hand(docs, monkeypatch, unit, known):
    """Scores from counts of whole words, given only the class of each unit; rare words meet their counts."""
    monkeypatch.setattr(brown, "UNIT_SHARE", unit)
    monkeypatch.setattr(brown, "KNOWN_SHARE", known)
    m = brown.fit(*train_of(docs))
    toks = {r[0]: [w.encode() for w in words_of(lower(r[1] or ""))] + [None] for r in ROWS}
    train = [t for i, t in toks.items() if zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(w for t in train for w in t)
    total = sum(c.values())
    shape = lambda w: min(len(w), 15) * 256 + w[-1] if w is not None else 0
    own = {w for w in c if c[w] >= known * total}
    unit_of = lambda w: w if w in own else shape(w)
    number = lambda w: int(m.units.of(*(x[:1] for x in brown.tokens(w.decode() if w is not None else "")))[0])
    cls = lambda w: int(m.cls[number(w) if w in own else shape(w)])
    members = collections.Counter(cls(w) for w in own) + collections.Counter(m.cls[: brown.SHAPES].tolist())
    seen = collections.Counter(unit_of(w) for t in train for w in t)
    pair = collections.Counter((cls(a), cls(b)) for t in train for a, b in zip(t[-1:] + t[:-1], t, strict=True))
    row, size = collections.Counter(), collections.Counter()
    for (a, b), n in pair.items():
        row[a] += n
        size[b] += n
    rare_n, rare_v = collections.Counter(), collections.Counter()
    for w in c.keys() - own:
        rare_n[shape(w)] += c[w]
        rare_v[shape(w)] += 1

    def log_p(a, w):
        a, b, s = cls(a), cls(w), shape(w)
        p = (pair[a, b] + 5 * (size[b] + 1) / (total + 48)) / (row[a] + 5)
        p *= (seen[unit_of(w)] + 0.1) / (size[b] + 0.1 * members[b])
        return math.log10(p if w in own else p * (c[w] + 0.1) / (rare_n[s] + 0.1 * (rare_v[s] + 1)))

    want = {i: sum(log_p(a, w) for a, w in zip(t[-1:] + t[:-1], t, strict=True)) for i, t in toks.items()}
    n, v = total, len(c)
    for r in brown.score_corpus(docs).collect():
        t = toks[r["doc_id"]]
        assert math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9)
        assert r["n_known"] == sum(c[w] > 0 for w in t)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)


def test_each_word_joins_the_likeliest_class(docs, monkeypatch):
    monkeypatch.setattr(brown, "CLASSES", 4)
    train, counts = train_of(docs)
    rows = counts.toPandas().sort_values("n")
    units = brown.Units(rows["h"].to_numpy(np.int64).view(np.uint64))
    start = np.arange(units.count) % 4
    seqs = [units.of(*brown.tokens(r["text"] or "")) for r in train.collect()]

    def table_of(cls):
        t = np.zeros((4, 4))
        for s in seqs:
            np.add.at(t, (cls[np.roll(s, 1)], cls[s]), 1)
        return t

    def likelihood(cls):
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        t = table_of(cls)
        return f(t) - f(t.sum(0)) - f(t.sum(1))

    loose = np.zeros(units.count, bool)
    loose[units.of(rows["h"].to_numpy(np.int64).view(np.uint64), np.zeros(len(rows), np.int64))[:: len(rows) // 25]] = True
    got = brown.place(train, units, start, loose, table_of(start))
    assert (got[~loose] == start[~loose]).all() and (got != start).any()
    for u in np.flatnonzero(loose):
        tried = []
        for c in range(4):
            cls = start.copy()
            cls[u] = c
            tried.append(likelihood(cls))
        assert tried[got[u]] > max(tried) - 1e-6
    assert (brown.class_bigrams(train, units, got) == table_of(got)).all()


def test_exchange_parts_two_alternating_sets():
    rnd = random.Random(1)
    seq = [rnd.choice((0, 2, 4)) if i % 2 else rnd.choice((1, 3, 5)) for i in range(4000)]
    pairs = collections.Counter(itertools.pairwise(seq))
    a, b, n = (np.array(x) for x in zip(*[(i, j, c) for (i, j), c in pairs.items()], strict=True))
    cls, table = brown.exchange(a, b, n.astype(float), 2)
    assert len({cls[0], cls[2], cls[4]}) == 1 and cls[0] != cls[1] and table.sum() == n.sum()


# 3 -----------------------------------------------------------------------------------------------


def spans_of(t):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, t or "") if ok(m.group())]


PERSONAL = [
    "é mail a.b@x.org, b@c@d.e.f x@y.com_foo@z.org", "1.2.3.4.5.6.7.8 and 256.1.1.1 or 001.002.003.255", "card 4111 1111 1111 1111 or 4111-1111-1111-1112 4111111111111111", "+1 (578) 555-6437 +12 +1234567890123456 ++44 20 7946 0958",
    "a@b.c 1.1.1.1 " * 150, "9" * 20000, "a." * 5000 + "@x.y" + ".z" * 5000, "", None, "iban GB82 WEST 1234 5698 7654 32 and GB83 WEST 1234 5698 7654 32 AT61 1904 3002 3457 3201 SOON", "1 2 3 4 5 6 7 8 9 " * 800, "ü" * 50 + "x@y.zz",
]


def test_personal_data(spark):
    df = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string").withColumn("PII", F.lit("clash"))
    for r in pii.detect(df).collect():
        got = [(s["kind"], s["start"], s["end"]) for s in r["pii"]]
        assert [s for s in got if s[0] != "iban"] == spans_of(r["text"])
        assert [s for s in got if s[0] == "iban"] == ([("iban", 5, 32), ("iban", 65, 89)] if r["doc_id"] == 9 else [])


def test_redaction_removes_every_span(spark):
    df = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string")
    for r in pii.redact(df).collect():
        t = PERSONAL[r["doc_id"]]
        if not t:
            assert r["text"] == t
            continue
        marks = sorted((s, e, k) for k, s, e in spans_of(t) + ([("iban", 5, 32), ("iban", 65, 89)] if r["doc_id"] == 9 else []))
        out, at = [], 0
        for s, e, k in marks:
            if s >= at:
                out += [t[at:s], f"[{k.upper()}]"]
            at = max(at, e)
        assert r["text"] == "".join(out) + t[at:]
    assert pii.redact(df.limit(0)).count() == 0


# 4 -----------------------------------------------------------------------------------------------


def test_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    x[100:160] = x[7] + rng.normal(scale=0.08, size=(60, 16))
    x[200:205] = x[8]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [1.0, None] * 8), (404, [1.0] * 3), (405, [0.5, 2.0]), (406, [1.0, 4.0]), (407, [4.0, -1.0])]
    got = {r["id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.95) & ~np.eye(400, dtype=bool)
    found = sum(got[i]["n_links"] for i in range(400))
    assert 0.9 * link.sum() <= found <= link.sum()
    assert all(got[i]["n_links"] <= link[i].sum() for i in range(400))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (*range(400, 405), 407))
    assert [got[i]["component"] for i in (405, 406)] == [405, 405] and got[406]["n_links"] == 1
    assert all(got[i]["component"] == 8 for i in (8, 200, 204)) and not got[200]["kept"]
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_in_a_hot_group(spark, monkeypatch):
    """Distinct near copies that spread over hundreds of cells, with codebooks as of a large table."""
    fit = embeddings.fit
    monkeypatch.setattr(embeddings, "fit", lambda vectors, count: fit(vectors, 32 * 128 * 128))
    monkeypatch.setattr(embeddings, "FILED", 300)
    monkeypatch.setattr(embeddings, "ASKING", 200)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1_500, 64))
    x[::3] = x[0] + 0.16 * rng.normal(size=(500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r["id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == (linked.sum(1) - 1).tolist()
    top = np.arange(len(x))
    while (low := np.where(linked, top, len(x)).min(1)).tolist() != top.tolist():
        top = low
    assert [got[i]["component"] for i in range(len(x))] == top.tolist()


# 5 -----------------------------------------------------------------------------------------------


def test_byte_pairs(docs):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["it's <|endoftext|>  we'LL\r\n\n x", "日本語 🙂   \u0085 \x1c é́", "𐐀 ²³ ½"]
    df = docs.select("doc_id", "text", F.lit(1).alias("IDS")).unionByName(docs.sparkSession.createDataFrame([(1000 + i, t, 1) for i, t in enumerate(odd)], "doc_id long, text string, IDS int"))
    for r in bpe.decode(bpe.encode(df)).collect():
        t = r["text"] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == lib.encode_ordinary(t) and r["decoded"] == t.encode()
    c = bpe.coder(bpe.default_vocabulary())
    start, end, first, last = c.spans(c.encode(["aé🙂b"])[0])
    assert start[0] == 0 and end[-1] == 8 and first[0] == 0 and last[-1] == 4 and (start[1:] == end[:-1]).all()


def test_byte_pairs_of_long_blanks():
    c = bpe.coder(bpe.default_vocabulary())
    for t in ("a" + " " * 30_000 + "b", " " * 30_000 + "\n" * 20_000 + ".x", "1" + "\u3000" * 10_001, " " * 9_999 + "\t" + "é  z" + " " * 40_000 + "'s"):
        assert np.frombuffer(c.encode([t])[0], "<u4").tolist() == c.lib.encode_ordinary(t)
    many = "a" + " " * 3_000_000 + "b"
    assert c.decode(c.encode([many])[0]) == many.encode()


def test_byte_pairs_take_one_pass_and_equal_another_library(spark, docs, tmp_path, capsys):
    import public_tokenizers
    from tokenizers import Tokenizer

    from dealforge.llm import queries

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op5_byte_bpe(spark, str(tmp_path))
    out.explain()
    assert capsys.readouterr().out.count("MapInArrow ") == 1
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t, *_ in ROWS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


# 6 -----------------------------------------------------------------------------------------------


def test_mix(docs, none):
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    size = {r[0]: len(words_of(r[1])) for r in ROWS}
    source = {r[0]: r[3] for r in ROWS}
    plan = mixing.plan_mix(sized)
    got = {r["doc_id"]: r for r in mixing.mix(sized, plan).collect()}
    assert {i: r["size"] for i, r in got.items()} == size
    order = sorted({s for s in source.values() if s is not None}) + [None]
    total = {s: sum(size[i] for i in size if source[i] == s) for s in order}
    left, target, open_ = 1.5 * sum(total.values()), {}, dict(zip(order, itertools.cycle((5, 2, 1))))
    while open_:
        level = left / sum(open_.values())
        over = [s for s, w in open_.items() if w * level > 2 * total[s]]
        if not over:
            target |= {s: w * level for s, w in open_.items()}
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
            del open_[s]
    for s in order:
        mine = [r for i, r in got.items() if source[i] == s]
        assert math.isclose(mine[0]["target"], target[s], rel_tol=1e-9) and mine[0]["source_size"] == total[s]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - target[s]) <= max(r["size"] for r in mine) / 2 + 1
        assert max(r["copies"] for r in mine) <= 2
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(sized, mixing.plan_mix(sized)).collect()}
    assert again == {i: r["copies"] for i, r in got.items()}
    assert mixing.mixed_rows(docs).count() == sum(again.values())
    assert mixing.mixed_rows(none).count() == 0
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("whole", "CUT", "odds", "fill", "copies", "_u", "_s", "size")])
    assert mixing.mixed_rows(clash).columns == clash.columns and mixing.mixed_rows(clash).count() == sum(again.values())


# 7 -----------------------------------------------------------------------------------------------


def test_language(spark):
    train = spark.createDataFrame([("the cat and the dog " * 5, "en"), ("le chat et le chien " * 5, "fr"), (None, "fr"), ("x", None)], "text string, lang string")
    model = language.train(train)
    rows = [(1, "the dog and the cat", "h", "com", None), (2, "le chien et le chat", "h", "com", "fr"), (3, "", "f", "fr", "fr"), (4, None, None, None, None), (5, "le chat et le chien", "f", "fr", None)]
    df = spark.createDataFrame(rows, "id int, text string, host string, suffix string, declared string")
    got = {r["id"]: r for r in language.identify(df, model).collect()}
    assert [got[i]["lang_id"] for i in (1, 2, 3, 5)] == ["en", "fr", "fr", "fr"] and 0 < got[4]["confidence"] <= 1
    assert language.identify(df.limit(0), model).count() == 0
    page = spark.createDataFrame([("https://u@A.example.FR:80/x", "<HTML lang='fr-FR'><script>x</script><p>a &amp; b</p>")], "url string, html string")
    r = page.select(language.host(F.col("url")).alias("h"), language.declared(F.col("html")).alias("d"), language.visible_text(F.col("html")).alias("t")).first()
    assert (r["h"], r["d"], r["t"].split()) == ("a.example.fr", "fr", ["a", "&", "b"])
    assert [tuple(r) for r in language.identify(df, language.train(train.limit(0)), keep=["id"]).select("lang_id").distinct().collect()] == [(None,)]


def test_language_posterior(spark):
    """Priors of hosts and suffixes, leave-one-out and declarations, by hand from what the texts say."""
    rnd = random.Random(11)
    voc = {"en": ["the", "cat", "and", "dog", "sat"], "fr": ["le", "chat", "et", "chien", "assis"], "de": ["die", "katze", "und", "hund"]}
    text = lambda k: " ".join(rnd.choices(voc[k], k=3))
    model = language.train(spark.createDataFrame([(text(k), k) for k in voc for _ in range(9)], "text string, lang string"))
    rows = [(i, rnd.choice([text("en"), text("fr"), text("de"), "", None]), rnd.choice(["a.fr", "b.fr", "c.de", None]), rnd.choice([None, "en", "fr", "xx"])) for i in range(60)]
    rows = [(i, t, h, h and h[-2:], d, i) for i, t, h, d in rows]
    df = spark.createDataFrame(rows, "id int, text string, host string, suffix string, declared string, h0 int")
    logs = {r["id"]: np.array(r["text_logs"]) for r in language.text_evidence(df, model).collect()}
    says = {i: np.exp(x) / np.exp(x).sum() for i, x in logs.items()}
    total = sum(says.values()) + 1
    for r in language.identify(df, model).collect():
        i = r["id"]
        _, _, h, sfx, d, _ = rows[i]
        at_sfx = sum((says[j] for j in says if sfx and rows[j][3] == sfx), np.zeros(3))
        at_host = sum((says[j] for j in says if h and rows[j][2] == h and j != i), np.zeros(3))
        mid = (at_sfx + 20 * total / total.sum()) / (at_sfx.sum() + 20)
        prior = (at_host + 5 * mid) / (at_host.sum() + 5)
        said = np.array([0.8 if d == x else 0.1 for x in model[0]]) if d in model[0] else np.ones(3)
        post = says[i] * prior * said
        assert r["lang_id"] == model[0][int(post.argmax())] and math.isclose(r["confidence"], post.max() / post.sum(), rel_tol=1e-9) and r["h0"] == i


# 8 -----------------------------------------------------------------------------------------------


def test_preferences(spark):
    s = "pair_id long, turn long, role string, text string"
    a = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (2, 0, "user", "same"), (3, 0, "user", "alone"), (None, 0, "user", "x"), (1, 1, "assistant", "yes"), (4, 0, None, None)], s)
    b = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "no"), (2, 0, "user", "same"), (4, 0, "user", "")], s)
    got = sorted((r["pair_id"], r["part"], r["turn"], r["train"]) for r in chat.preference_rows(a, b).collect())
    assert got == [(1, "chosen", 1, True), (1, "chosen", 2, False), (1, "prompt", 0, False), (1, "rejected", 1, True), (4, "chosen", 0, False), (4, "rejected", 0, False)]
    assert chat.preference_rows(a.limit(0), b.limit(0)).count() == 0


def test_crossed_conversations_agree_as_far_as_they_do(spark):
    rnd = random.Random(6)
    turns = {(c, t): (rnd.choice(["user", "assistant", "assistant"]), rnd.choice("xy")) for c in range(60) for t in range(rnd.randint(1, 7))}
    df = spark.createDataFrame([(c, t, *x) for (c, t), x in turns.items()], "conv_id long, turn long, role string, text string")
    got = sorted((r["pair_id"], r["part"], r["turn"], r["role"], r["text"], r["train"]) for r in chat.preference_rows(*chat.crossed(df)).collect())
    want, depths = [], set()
    for c in range(60):
        own, other = ({t: x for (k, t), x in turns.items() if k == o} for o in (c, c ^ 1))
        meet = [t for t in own if t in other and own[t][0] == other[t][0] == "assistant"]
        if not meet:
            continue
        at = min(meet) if c // 2 % 2 == 0 else max(meet)
        rejected = {t: x for t, x in own.items() if t < at} | {t: x for t, x in other.items() if t >= at}
        differ = [t for t in own.keys() | rejected.keys() if own.get(t) != rejected.get(t)]
        if differ:
            depths.add(min(differ) - at)
            for part, side in (("prompt", own), ("chosen", own), ("rejected", rejected)):
                want += [(c, part, t, r, f"<|{r}|>\n{x}<|end|>\n", part != "prompt" and r == "assistant") for t, (r, x) in side.items() if (t < min(differ)) == (part == "prompt")]
    assert got == sorted(want) and len(depths) > 1


# 9 -----------------------------------------------------------------------------------------------


def shingle_components(texts):
    sets = {}
    for i, t in texts:
        w = words_of(lower(t or ""))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets.items(), 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = find(i), find(j)
            top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_words_of_one_pattern_differ(spark):
    """The Thue-Morse word and its complement, equal under any polynomial modulo 2 ** 64, are two words."""
    a, b = ("".join(pair[bin(i).count("1") % 2] for i in range(1024)) for pair in ("ab", "ba"))
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} x"), (4, a.upper())], "doc_id long, text string")
    assert {r["id"]: r["component"] for r in jaccard.link_components(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(held, b)] + [(i, f"{a} word word") for i in range(100) if zlib.crc32(str(i).encode()) % 10]
    scored = {r["doc_id"]: r["n_known"] for r in brown.score_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert scored[held] == 1  # the end alone


@pytest.mark.parametrize("block", [None, 200])
def test_jaccard(docs, none, monkeypatch, block):
    if block:
        monkeypatch.setattr(jaccard, "QUERY_ITEMS", block)
        monkeypatch.setattr(jaccard, "INDEX_ITEMS", 2 * block)
    got = {r["id"]: (r["n"], r["component"]) for r in jaccard.link_components(docs).collect()}
    want = shingle_components([(r[0], r[1]) for r in ROWS])
    assert got == want and len({c for _, c in want.values()}) < len(want)
    if not block:
        assert sorted(r["doc_id"] for r in jaccard.one_of_each(docs).collect()) == sorted({c for _, c in want.values()})
        assert jaccard.link_components(none).count() == 0
        clash = docs.select("*", *[F.lit(1).alias(c) for c in ("id", "n", "REP", "kept_id", "component")])
        assert jaccard.one_of_each(clash).columns == clash.columns and jaccard.one_of_each(clash).count() == len({c for _, c in want.values()})


# 10 ----------------------------------------------------------------------------------------------


def counts_of(t):
    w = words_of(t)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), dup, len(hit)


def test_language_keeps_columns_of_any_name(spark, docs, none):
    model = language.train(docs)
    nothing = F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", nothing.alias("host"), nothing.alias("suffix"), nothing.alias("declared"), F.lit("mine").alias("says"), F.lit(7).alias("text_logs"), F.lit("x").alias("_says"))
    got = language.identify(rows, model).collect()
    assert len(got) == len(ROWS) and {(r["says"], r["text_logs"], r["_says"]) for r in got} == {("mine", 7, "x")}
    empty = none.select("doc_id", "text", nothing.alias("host"), nothing.alias("suffix"), nothing.alias("declared"))
    assert language.identify(empty, model).count() == 0


def test_quality(docs, none):
    got = {r["doc_id"]: r for r in quality.assess(docs.select("*", *[F.lit(1).alias(c) for c in ("KEPT", "low", "HIGH", "_lang", "_band")])).collect()}
    for i, t, *_ in ROWS:
        n = counts_of(t)
        r = got[i]
        assert tuple(r[c] for c in quality.COUNTS) == n
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    assert quality.assess(none).count() == 0


def test_perplexity_tells_noise_from_text(spark):
    rnd = random.Random(5)
    plain = ["the cat sat on the mat and then the dog ran to the man " * 3] * 40
    noise = ["".join(rnd.choices("qxzjkvw", k=6)) + " " for _ in range(60)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*plain, "".join(noise)])], "doc_id long, text string, lang string")
    m = quality.train(df)
    logs = m.word_logs("en", ["the", "qxzjkv"])
    assert logs[0] > logs[1]
    assert all(math.isfinite(x) for x in m.word_logs("none such", ["the", "é"]))


def test_model_keeps_its_lower_orders_as_the_table_grows(spark, monkeypatch):
    monkeypatch.setattr(quality, "MIN_SHARE", 1e-4)
    rnd = random.Random(8)
    syl = ["ba", "ko", "mi", "tu", "re", "na", "sel", "dor", "vin"]
    text = lambda: " ".join("".join(rnd.choices(syl, k=rnd.randint(1, 4))) for _ in range(80))
    rows = [(i, text(), "en") for i in range(60)] + [(60, " ".join("".join(rnd.choices("#*$%&<>", k=7)) for _ in range(80)), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(30))))
    lower = lambda d: {(r["k"], r["gram"]) for r in quality.model_tables(d).where("k < 4 and p is not null").collect()}
    assert lower(many) == lower(df) and {g for k, g in lower(df) if k == 1} >= set("bakomituren")
    verdicts = lambda d: {(r["doc_id"], r["kept"]) for r in quality.assess(d, keep=["doc_id"]).collect()}
    assert verdicts(many) == verdicts(df)
    sums = collections.Counter()
    for r in quality.model_tables(df).where("k = 4").collect():
        sums[r["gram"][:3]] += r["back"] if r["p"] is None else r["p"]
    assert all(math.isclose(x, 1) for x in sums.values())


def kneser_ney(texts):
    """Natural log probability of a word by modified Kneser-Ney over all 4-grams of the texts' words."""
    counts = {4: collections.Counter()}
    for w in (w for t in texts for w in words_of(t)):
        s = f"\2\2\2{w.lower()}\2"
        counts[4].update(s[i : i + 4] for i in range(len(s) - 3))
    for k in (3, 2, 1):
        counts[k] = collections.Counter()
        for g, n in counts[k + 1].items():
            counts[k][g[1:]] += n if g.startswith("\2\2") else 1
    share, back = {}, {}
    for k, c in counts.items():
        have = collections.Counter(c.values())
        y = have[1] / (have[1] + 2 * have[2]) if have[1] + 2 * have[2] else None
        cut = [0.5 if y is None or not have[i] else i - (i + 1) * y * have[i + 1] / have[i] for i in (1, 2, 3)]
        cut = [max(0, min(i, d)) for i, d in zip((1, 2, 3), cut)]
        kind = lambda g: 1 < k < 4 and g.startswith("\2")
        of_kind = collections.Counter()
        for g, n in c.items():
            of_kind[kind(g)] += n
        total, held = collections.Counter(), collections.Counter()
        total.update({g[:-1]: of_kind[kind(g)] * 1e-6 for g in c})
        for g, n in c.items():
            total[g[:-1]] += n
            held[g[:-1]] += n - cut[min(n, 3) - 1]
        share |= {(k, g): (n - cut[min(n, 3) - 1]) / total[g[:-1]] for g, n in c.items()}
        back |= {(k, g): 1 - held[g] / total[g] for g in total}

    def p(g):
        return share.get((len(g), g), 0) + back.get((len(g), g[:-1]), 1) * (p(g[1:]) if len(g) > 1 else 1 / 0x110000)

    def log(w):
        s = f"\2\2\2{w.lower()}\2"
        return sum(math.log(max(p(s[i : i + 4]), 1e-12)) for i in range(len(s) - 3))

    return log


@pytest.mark.parametrize("sent", [1_000_000, 60, 0])
def test_no_ngram_is_left_out_of_the_model(spark, docs, monkeypatch, sent):
    monkeypatch.setattr(quality, "SENT", sent)
    model = quality.train(docs)
    assert len(model.known.keys) <= sent
    logs = {lang: kneser_ney([t for _, t, x, *_ in ROWS if x == lang]) for lang in ("en", "fr", None)}
    logs["new"] = kneser_ney([])
    others = [(0, "Bako bakqo é 日本 unseen", "en"), (0, "Bako bako", "en"), (0, "ba", "new"), (0, "", "new"), (None, "tu tux", None)]
    for table, rows in ((docs, [(i, t, x) for i, t, x, *_ in ROWS]), (spark.createDataFrame(others, "doc_id long, text string, lang string"), others)):
        got = quality.measure(table, model, keep=["doc_id", "text", "lang"]).collect()
        assert len(got) == len(rows)
        for r in got:
            words = words_of(r["text"])
            want = -sum(map(logs[r["lang"]], words)) / len(words) if words else None
            assert r["log_ppl"] is None if want is None else math.isclose(r["log_ppl"], want, rel_tol=1e-9)
    words = ["bako", "qx日"]
    assert np.allclose(model.word_logs("en", words), list(map(logs["en"], words)))


def test_digest_is_of_the_whole_text(docs):
    long = "word " * 60000
    df = docs.sparkSession.createDataFrame([(1, long)], "doc_id long, text string")
    r = bpe.decode(bpe.encode(df)).select(F.sha2("decoded", 256)).first()
    assert r[0] == hashlib.sha256(long.encode()).hexdigest()
