"""Language identification by Bayesian evidence fusion.

Four kinds of evidence on a row's language are multiplied: the likelihood of its text under each
language's character trigrams, the language that its markup declares, its address's suffix, and a
prior of its host. Host priors are counts of what the text alone says, by grouped aggregation,
smoothed towards the counts of the host's suffix and these towards all rows; a row's own say is
left out of its host's count.

Cases: rows without text rely on the other evidence and, without any, get the commonest language;
a null host, suffix or declaration says nothing; unknown declarations say nothing; of languages
equally likely the last by name wins; repeated rows each have their say; texts are read whole
whatever their length; other columns stay, whatever their names; an empty table gives an empty
result; a training table without labelled text knows no language, and rows get null ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, map_batches, mix64, saved, small_batches, texts, without

BITS = 14
#: Trigrams of a text count as so many independent ones at most.
EFFECTIVE = 40.0
#: How sure a declaration is of its language, and the weights of the priors above a host.
DECLARED = 0.8
PSEUDO_HOST, PSEUDO_SUFFIX = 5.0, 20.0
#: Hosts or suffixes whose votes may be broadcast; more are joined by a shuffle.
FEW = 200_000


def trigram_counts(text: str) -> np.ndarray:
    """Counts of a text's hashed character trigrams."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(1 << BITS, np.int64)
    key = mix64(c[:-2] | (c[1:-1] << np.uint64(21)) | (c[2:] << np.uint64(42)))
    return np.bincount((key >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each trigram bucket in each of them.

    Counted over all labelled texts; the table has ``2 ** BITS`` buckets a language.
    """

    def run(batches):
        for b in batches:
            sums: dict[str, np.ndarray] = {}
            for lang, text in zip(b.column("lang").to_pylist(), texts(b, "text"), strict=True):
                got = trigram_counts(text)
                sums[lang] = sums[lang] + got if lang in sums else got
            for lang, s in sums.items():
                at = np.flatnonzero(s)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(s[at], pa.int64())], names=["lang", "bucket", "n"])

    slim = df.where(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = small_batches(slim).mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.full((len(langs), 1 << BITS), 0.5)
    table[rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64), rows["bucket"].to_numpy(np.int64)] += rows["n"].to_numpy(np.int64)
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def text_evidence(df: DataFrame, model, text_col: str = "text", keep: list[str] | None = None, out_col: str = "text_logs") -> DataFrame:
    """Add ``out_col``: for each language the tempered log likelihood of the text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(b):
        table = shared.value[1]
        rows = []
        for t in texts(b, text_col):
            n = trigram_counts(t)
            at = np.flatnonzero(n)
            total = n[at].sum()
            logs = table[:, at] @ n[at] * (min(1.0, EFFECTIVE / total) if total else 0.0)
            rows.append((logs - logs.max()).tolist())
        return {out_col: pa.array(rows, pa.list_(pa.float64()))}

    return map_batches(df, make, [(out_col, "array<double>")], keep)


def visible_text(html: Column) -> Column:
    """A page's text: without scripts, styles, comments and tags, with the common entities.

    What is never closed reaches to the page's end, so each character is read once.
    """
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[^>]*+>", " ")
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(c))
    return t


def declared(html: Column) -> Column:
    """The primary language tag that the markup declares, or null."""
    return F.lower(F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1), F.lit("")))


def host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))


def suffix(host_col: Column) -> Column:
    return F.nullif(F.regexp_extract(host_col, r"\.([^.]+)$", 1), F.lit(""))


def identify(df: DataFrame, model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``text_lang``, ``lang_id`` and ``confidence`` to rows with ``host``, ``suffix`` and ``declared``."""
    langs = model[0]
    names = list(dict.fromkeys([*(df.columns if keep is None else keep), "host", "suffix", "declared"]))
    df = without(df, "text_lang", "lang_id", "confidence")
    if not langs:
        none = F.lit(None).cast("string")
        return df.select(*[c for c in names if c in df.columns], none.alias("text_lang"), none.alias("lang_id"), F.lit(None).cast("double").alias("confidence"))
    logs, says = fresh(df, "_text_logs", "_says")
    scored = text_evidence(df, model, text_col, [c for c in names if c.lower() not in ("text_lang", "lang_id", "confidence")], logs)
    # what the text alone says, as a probability of each language
    ps = [F.exp(F.element_at(logs, i + 1)) for i in range(len(langs))]
    total = sum(ps[1:], ps[0])
    scored = saved(scored.withColumn(says, F.array(*[p / total for p in ps])), "language-text")
    say = lambda i: F.element_at(says, i + 1)
    # one row of as many sums as there are languages
    overall = scored.agg(*[(F.coalesce(F.sum(say(i)), F.lit(0.0)) + 1).alias(f"g{i}") for i in range(len(langs))]).first()
    host_of, suffix_of = fresh(scored, "_host", "_suffix")

    def votes(key, name):
        """``(key, sums)``, broadcast if few; beyond that a table, so that Spark can split a hot key's rows."""
        t = scored.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.array(*[F.sum(say(i)) for i in range(len(langs))]).alias("sums"))
        t = saved(t.select(F.struct("key", "sums").alias(name)), "language-votes")
        return F.broadcast(t) if t.limit(FEW + 1).count() <= FEW else t

    out = scored.join(votes("host", host_of), F.col("host") == F.col(host_of)["key"], "left").join(votes("suffix", suffix_of), F.col("suffix") == F.col(suffix_of)["key"], "left")
    part = lambda k, i: F.coalesce(F.element_at(F.col(k)["sums"], i + 1), F.lit(0.0))
    add = lambda k: sum([part(k, i) for i in range(1, len(langs))], part(k, 0))
    gs, ss, hs = sum(overall), add(suffix_of), add(host_of)
    posts = []
    for i, lang in enumerate(langs):
        mid = (part(suffix_of, i) + PSEUDO_SUFFIX * overall[i] / gs) / (ss + PSEUDO_SUFFIX)
        own = F.when(F.col("host").isNotNull(), say(i)).otherwise(0.0)
        one = F.when(F.col("host").isNotNull(), 1.0).otherwise(0.0)
        prior = (F.greatest(part(host_of, i) - own, F.lit(0.0)) + PSEUDO_HOST * mid) / (F.greatest(hs - one, F.lit(0.0)) + PSEUDO_HOST)
        said = F.when(F.col("declared") == lang, DECLARED).when(F.col("declared").isin(langs), (1 - DECLARED) / max(1, len(langs) - 1)).otherwise(1.0)
        posts.append(say(i) * prior * said + 1e-300)
    norm = sum(posts[1:], posts[0])
    best = F.greatest(*[F.struct(p.alias("p"), F.lit(lang).alias("lang")) for p, lang in zip(posts, langs, strict=True)]) if len(langs) > 1 else F.struct(posts[0].alias("p"), F.lit(langs[0]).alias("lang"))
    first = F.greatest(*[F.struct(say(i).alias("p"), F.lit(lang).alias("lang")) for i, lang in enumerate(langs)]) if len(langs) > 1 else F.struct(say(0).alias("p"), F.lit(langs[0]).alias("lang"))
    return out.select(*[c for c in names if c in scored.columns], first["lang"].alias("text_lang"), best["lang"].alias("lang_id"), F.least(F.lit(1.0), best["p"] / norm).alias("confidence"))
