"""Quality rules: counts per text and a language model's perplexity band.

The model is an interpolated modified Kneser-Ney model over the characters of words, one per
language. Spark counts the n-grams of all texts; every lower order counts distinct left
neighbours. No n-gram is left out: each order is a table of discounted shares, back-off weights and
interpolated probabilities. The most frequent n-grams of the top order, at most ``SENT`` of all
languages, are sent to the workers as a sorted array of 64-bit hashes with their log
probabilities. What a text holds besides those is written out as n-grams and scored by joins with
the tables, which also back off for n-grams that no text had. A context hands down the weight that
its discounts took and that of ``MIN_SHARE`` of all counts, so that rare contexts rely on lower
orders however large the table is; its probabilities sum to one.

A text's perplexity is taken per word over its whole words. A language's band is set by the
quartiles of all its texts; texts outside are rejected.

Cases: a null or empty text has no words, counts of zero and no perplexity, and fails the base
rules; a null language is a language of its own, apart from the empty one; repeated rows each count;
ties do not matter, as no text is ranked; texts are read whole whatever their length; columns that
have the name of a new one are replaced, others stay; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import MIX1, WORD_RE, fresh, give_back, map_batches, mix64, saved, small_batches, texts, without

ORDER = 4
#: Share of its order's counts in its language by which each context's own count is raised in favour of the next lower order.
MIN_SHARE = 1e-6
#: At most so many n-grams are sent to the workers, the most frequent ones.
SENT = 1_000_000
#: The share of a character that was never seen, and the least probability that counts.
UNSEEN, LEAST_P = 1.0 / 0x110000, 1e-12
#: A band reaches so many interquartile ranges beyond the quartiles of the log perplexity,
REACH = 8.0
#: and, since few words say little, this over the square root of a text's words beyond that.
SLACK = 5.0
LEAST_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
EDGE = "\x02"
#: Words that a worker remembers with their log probability, and their characters, before it starts anew.
MEMO, MEMO_CHARS = 200_000, 4_000_000
#: Characters of texts whose words a worker counts before it hands the counts on.
COUNTED_CHARS = 1 << 26
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: Stands for a null language; no language has this name.
NO_LANG = "\0"
#: What the model sees of a word: lower case, every ASCII digit as 0.
DIGITS = str.maketrans("123456789", "0" * 9)


def _plain(text: str) -> str:
    return text.lower().translate(DIGITS)


def text_counts(text: str, words: list[str]) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines, words in repeated windows."""
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += WORD_RE.search(line) is not None
        else:
            seen.add(line)
    chars = len(text) - sum(map(text.count, BLANKS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeat_words(words)


def repeat_words(words: list[str], size: int = WINDOW) -> int:
    """How many words lie in a window of ``size`` words that the text holds twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    key = ids[:n].copy()
    for k in range(1, size):
        key *= MIX1
        key += ids[k : n + k]
    s = np.sort(key)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(key, again))
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + size, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def _by_language(batch: pa.RecordBatch, lang_col: str) -> list[str]:
    return [str(x) if x is not None else NO_LANG for x in batch.column(lang_col).to_pylist()]


def _ngram_batches(text_col: str, lang_col: str, order: int):
    """Partial counts of the top order; a word has its edges around it."""

    def counted(words):
        langs, grams, ns = [], [], []
        for lang, counts in words.items():
            found: Counter = Counter()
            pad = EDGE * (order - 1)
            for w, n in counts.items():
                s = f"{pad}{_plain(w)}{EDGE}"
                for i in range(len(s) - order + 1):
                    found[s[i : i + order]] += n
            langs += [lang] * len(found)
            grams += found.keys()
            ns += found.values()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(ns, pa.int64())], names=["lang", "gram", "n"])

    def run(batches):
        words: dict[str, Counter] = {}
        chars = 0
        for b in batches:
            for lang, text in zip(_by_language(b, lang_col), texts(b, text_col), strict=True):
                words.setdefault(lang, Counter()).update(WORD_RE.findall(text))
                chars += len(text)
            if sum(map(len, words.values())) > MEMO or chars > COUNTED_CHARS:
                yield counted(words)
                words, chars = {}, 0
        yield counted(words)
        give_back()

    return run


def model_levels(df: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> dict[int, DataFrame]:
    """By order, ``(lang, gram, n, share, back, p)`` of all n-grams: count, discounted share of its
    context, weight that the context hands down, and probability with all lower orders."""
    slim = df.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    counts = small_batches(slim).mapInArrow(_ngram_batches("text", "lang", order), "lang string, gram string, n bigint")
    counted = {order: saved(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "quality-ngrams")}
    for k in range(order - 1, 0, -1):
        # continuation counts: distinct left neighbours; what begins a word has but one and keeps its count
        ends = F.substr("gram", F.lit(2)).alias("gram")
        n = F.sum(F.when(F.col("gram").startswith(EDGE * 2), F.col("n")).otherwise(1))
        counted[k] = saved(counted[k + 1].groupBy("lang", ends).agg(n.alias("n")), "quality-ngrams")
    levels: dict[int, DataFrame] = {}
    for k in range(1, order + 1):
        t = counted[k]
        # prior weights of counts of one kind: numbers of neighbours do not grow with the texts, counts of what begins a word do
        begins = F.lit(1 < k < order) & F.col("gram").startswith(EDGE)
        some = t.groupBy("lang").agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)], F.sum(F.when(begins, F.col("n"))).alias("head"), F.sum(F.when(~begins, F.col("n"))).alias("inner"))
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        safe = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(float(i)), F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.5))))
        some = some.select("lang", safe(1).alias("d1"), safe(2).alias("d2"), safe(3).alias("d3"), "head", "inner")
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        prior = (F.when(begins, F.col("head")).otherwise(F.col("inner")) * MIN_SHARE).alias("prior")
        t = t.join(F.broadcast(some), "lang").select("lang", "gram", "n", (F.col("n") - d).alias("own"), F.substring("gram", 1, k - 1).alias("ctx"), prior)
        ctx = t.groupBy("lang", "ctx").agg((F.sum("n") + F.max("prior")).alias("total"), F.sum("own").alias("held"))
        t = t.join(ctx, ["lang", "ctx"]).withColumns({"share": F.col("own") / F.col("total"), "back": 1 - F.col("held") / F.col("total")})
        under = F.lit(UNSEEN)
        if k > 1:
            t = t.withColumn("end", F.substr("gram", F.lit(2))).join(levels[k - 1].select("lang", F.col("gram").alias("end"), F.col("p").alias("under")), ["lang", "end"])
            under = F.col("under")
        levels[k] = saved(t.select("lang", "gram", "n", "share", "back", (F.col("share") + F.col("back") * under).alias("p")), "quality-levels")
    return levels


def _contexts(levels: dict[int, DataFrame], k: int) -> DataFrame:
    return levels[k].select("lang", F.substring("gram", 1, k - 1).alias("ctx"), "back").distinct()


def model_tables(df: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> DataFrame:
    """Rows ``(k, lang, gram, p, back)``: an n-gram's discounted probability and its weight as a context.

    ``p`` leaves out what the next lower order adds; ``back`` is what a text of this context hands
    down, 1 where the context was never seen. Order 0 is the uniform share of an unseen character.
    """
    none = F.lit(None).cast("double")
    levels = model_levels(df, text_col, lang_col, order)
    tables = [t.select(F.lit(k).alias("k"), "lang", "gram", F.col("share").alias("p"), none.alias("back")) for k, t in levels.items()]
    tables += [_contexts(levels, k).select(F.lit(k).alias("k"), "lang", F.col("ctx").alias("gram"), none.alias("p"), "back") for k in levels]
    return functools.reduce(DataFrame.unionByName, tables)


def gram_logs(grams: DataFrame, levels: dict[int, DataFrame]) -> DataFrame:
    """``(lang, gram, log)`` of distinct n-grams of the top order, seen or not."""
    order = max(levels)
    out = grams.select("lang", "gram", F.lit(UNSEEN).alias("p"))
    for k in range(1, order + 1):
        seen = levels[k].select("lang", F.col("gram").alias("end"), F.col("p").alias("seen"))
        out = out.withColumns({"end": F.substring("gram", order - k + 1, k), "ctx": F.substring("gram", order - k + 1, k - 1)})
        out = out.join(seen, ["lang", "end"], "left").join(_contexts(levels, k), ["lang", "ctx"], "left")
        out = out.select("lang", "gram", F.coalesce("seen", F.coalesce("back", F.lit(1.0)) * F.col("p")).alias("p"))
    return out.select("lang", "gram", F.log(F.greatest("p", F.lit(LEAST_P))).alias("log"))


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _hashes(flat: np.ndarray, starts: np.ndarray, k: int, seed: np.ndarray | int) -> np.ndarray:
    """Hashes of the ``k`` characters from each start on."""
    h = np.empty(len(starts), dtype=np.uint64)
    h[:] = seed
    for i in range(k):
        h = mix64(h + flat[starts + i].astype(np.uint64) + np.uint64(1))
    return h


def _keyed(order: int):
    """Hashes of languages' n-grams instead of their names."""

    def run(batches):
        for b in batches:
            grams, seed = b.column("gram").to_pylist(), functools.cache(_seed)
            flat = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32)
            seeds = np.array([seed(x) for x in b.column("lang").to_pylist()], np.uint64)
            keys = _hashes(flat, np.arange(len(grams)) * order, order, seeds)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column("log")], names=["key", "log"])

    return run


class Known:
    """Hashes of the most frequent n-grams, sorted, with their log probabilities."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray, order: int):
        by = np.argsort(keys)
        self.keys, self.logs, self.order = keys[by], logs[by], order

    def word_logs(self, lang: str, words: list[str]) -> tuple[list[float], dict[int, list[str]]]:
        """Of each word with its end the natural log probability of its known n-grams; by the word's place, its other n-grams."""
        pad, words = EDGE * (self.order - 1), [_plain(w) for w in words]
        text = "".join(f"{pad}{w}{EDGE}" for w in words)
        flat = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(w) + 1 for w in words])  # n-grams
        heads = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(np.arange(len(words)) * (self.order - 1), sizes)
        keys = _hashes(flat, at, self.order, _seed(lang))
        found, logs = np.zeros(len(at), dtype=bool), np.zeros(len(at))
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = self.keys[i] == keys
            logs = np.where(found, self.logs[i], 0.0)
        gaps: dict[int, list[str]] = {}
        lost = np.flatnonzero(~found)
        for w, i in zip((np.searchsorted(heads, lost, "right") - 1).tolist(), at[lost].tolist(), strict=True):
            gaps.setdefault(w, []).append(text[i : i + self.order])
        return np.add.reduceat(logs, heads).tolist(), gaps


class Model:
    """The tables of all n-grams, and of the most frequent ones what workers hold."""

    def __init__(self, levels: dict[int, DataFrame], known: Known):
        self.levels, self.known = levels, known

    def word_logs(self, lang: str, words: list[str]) -> list[float]:
        """Natural log probability of each word with its end."""
        logs, gaps = self.known.word_logs(lang, words)
        if gaps:
            grams = self.levels[1].sparkSession.createDataFrame([(lang, g) for g in {g for gs in gaps.values() for g in gs}], "lang string, gram string")
            rest = {r["gram"]: r["log"] for r in gram_logs(grams, self.levels).collect()}
            for w, gs in gaps.items():
                logs[w] += sum(map(rest.__getitem__, gs))
        return logs


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> Model:
    """The model of all texts; hashes of at most ``SENT`` n-grams reach the driver."""
    levels = model_levels(df, text_col, lang_col, order)
    top, least, left = levels[order], 1, SENT
    for r in sorted(top.groupBy(F.floor(F.log2("n")).alias("b")).count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            least = 2 ** (r["b"] + 1)
            break
    often = top.where(F.col("n") >= least).select("lang", "gram", F.log(F.greatest("p", F.lit(LEAST_P))).alias("log"))
    got = often.mapInArrow(_keyed(order), "key bigint, log double").toPandas()
    return Model(levels, Known(got["key"].to_numpy(np.int64).view(np.uint64), got["log"].to_numpy(np.float64), order))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Add the counts and ``log_ppl``, the mean negative log probability of a word."""
    shared = df.sparkSession.sparkContext.broadcast(model.known)
    memos: dict[str, dict[str, float]] = {}
    lost: dict[str, dict[str, list[str]]] = {}
    held: Counter = Counter()
    row, says, logs_col, rest = fresh(df, "_row", "_says", "_logs", "_rest")
    at = [0]

    def make(b):
        m = shared.value
        rows, logs, rests = [], [], []
        counted = []
        for lang, t in zip(_by_language(b, lang_col), texts(b, text_col), strict=True):
            words = WORD_RE.findall(t)
            counted.append((lang, text_counts(t, words), words))
        new: dict[str, set] = {}
        for lang, _, words in counted:
            memo = memos.setdefault(lang, {})
            lost.setdefault(lang, {})
            new.setdefault(lang, set()).update(set(words).difference(memo))
        for lang, words in new.items():
            if words:
                if len(memos[lang]) > MEMO or held[lang] > MEMO_CHARS:
                    memos[lang].clear()
                    lost[lang].clear()
                    held[lang] = 0
                    words = {w for x, _, ws in counted if x == lang for w in ws}
                every = list(words)
                held[lang] += sum(map(len, every))
                for i in range(0, len(every), 50_000):
                    part = every[i : i + 50_000]
                    found, gaps = m.word_logs(lang, part)
                    memos[lang].update(zip(part, found, strict=True))
                    lost[lang].update((part[j], grams) for j, grams in gaps.items())
        for lang, c, words in counted:
            rows.append(c)
            logs.append(sum(map(memos[lang].__getitem__, words)))
            gaps = lost[lang]
            grams = Counter(g for w in words if w in gaps for g in gaps[w]) if gaps else ()
            rests.append([{"gram": g, "n": n} for g, n in grams.items()] if grams else None)
        first = (TaskContext.get().partitionId() << 40) + at[0]
        at[0] += len(rows)
        out = {name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(COUNTS)}
        out |= {row: pa.array(range(first, first + len(rows)), pa.int64()), says: pa.array([x for x, *_ in counted], pa.string()), logs_col: pa.array(logs, pa.float64())}
        return out | {rest: pa.array(rests, pa.list_(pa.struct([("gram", pa.string()), ("n", pa.int64())])))}

    new = [(n, "bigint") for n in [*COUNTS, row]] + [(says, "string"), (logs_col, "double"), (rest, "array<struct<gram:string,n:bigint>>")]
    rows = saved(map_batches(df, make, new, keep), "quality-measured")
    shared.destroy()
    names = [c for c in rows.columns if c not in (row, says, logs_col, rest) and c.lower() != "log_ppl"]
    ppl = lambda logs: F.try_divide(-logs, F.col("n_words")).alias("log_ppl")
    if rows.where(F.col(rest).isNotNull()).isEmpty():
        return rows.select(*[F.col(f"`{c}`") for c in names], ppl(F.col(logs_col)))
    parts = rows.select(F.col(row).alias("row"), F.col(says).alias("lang"), F.explode(rest).alias("x")).select("row", "lang", "x.gram", "x.n")
    found = saved(gram_logs(parts.select("lang", "gram").distinct(), model.levels), "quality-rest")
    more = parts.join(found, ["lang", "gram"]).groupBy(F.col("row").alias(row)).agg(F.sum(F.col("n") * F.col("log")).alias(says))
    out = rows.drop(says, rest).join(more, row, "left")
    return saved(out.select(*[F.col(f"`{c}`") for c in names], ppl(F.col(logs_col) + F.coalesce(says, F.lit(0.0)))), "quality-measured")


def bands(measured: DataFrame, lang_col: str = "lang", reach: float = REACH) -> DataFrame:
    """Each language's lowest and highest accepted log perplexity."""
    q = F.percentile_approx("log_ppl", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10_000))
    b = measured.where(~base_failed()).groupBy(F.coalesce(F.col(f"`{lang_col}`"), F.lit(NO_LANG)).alias("_lang")).agg(q.alias("q"))
    span = F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(0.01)) * reach
    return b.select("_lang", (F.col("q")[0] - span).alias("low"), (F.col("q")[2] + span).alias("high"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


#: Limits of at most so many languages are broadcast.
FEW = 100_000


def judge(measured: DataFrame, limits: DataFrame, lang_col: str = "lang") -> DataFrame:
    """Add ``base_failed`` and ``kept``; ``limits`` has one row per language."""
    df = without(measured, "base_failed", "kept")
    (band,) = fresh(df, "_band")
    few = limits.limit(FEW + 1).count() <= FEW
    own = limits.select(F.struct("_lang", "low", "high").alias(band))
    df = df.join(F.broadcast(own) if few else own, F.coalesce(F.col(f"`{lang_col}`"), F.lit(NO_LANG)) == F.col(band)["_lang"], "left")
    slack = F.try_divide(F.lit(SLACK), F.sqrt("n_words"))
    inside = F.coalesce(F.col("log_ppl").between(F.col(band)["low"] - slack, F.col(band)["high"] + slack), F.lit(True))
    return df.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & inside}).drop(band)


def assess(df: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Train on ``df``, then add counts, ``log_ppl``, ``base_failed`` and ``kept`` to its rows."""
    names = keep if keep is not None else df.columns
    if lang_col not in names:
        names = [*names, lang_col]
    measured = measure(df, train(df, text_col, lang_col), text_col, lang_col, names)
    return judge(measured, saved(bands(measured, lang_col), "quality-bands"), lang_col)
