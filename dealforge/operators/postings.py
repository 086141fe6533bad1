"""Containment searches of many queries over a table of texts, by entries of an inverted index.

A text stands under each of its parts of up to three characters. A query has the entries that every
text with it must have; it meets only the texts under the one that fewest texts have, and there the
whole query is checked. So no query scans the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.stage import staged

GRAM = 3


def grams(text: Column, sizes: tuple[int, ...]) -> Column:
    """All parts of a text of these lengths; none of a length that it does not have."""

    def of(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: i <= F.length(text) - n + 1)
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))

    return F.concat(*[of(n) for n in sizes])


def part_entries(text: Column) -> Column:
    """The entries under which a text stands: all its parts of up to three characters."""
    return F.array_distinct(grams(text, tuple(range(1, GRAM + 1))))


def asked_entries(query: Column) -> Column:
    """Entries that every text containing the query has; a short query is an entry itself."""
    return F.when(F.length(query) <= GRAM, F.array(query)).otherwise(F.array_distinct(grams(query, (GRAM,))))


def candidates(known: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Each query of ``asked`` (query_id, *keys, further columns, entries) with the texts under its rarest entry.

    ``known`` has *keys, further columns and ``entries``. Of its entries only asked ones are kept, and
    queries are looked up under one of theirs each. Keys with nulls meet nothing.
    """
    on = [*keys, "entry"]
    asked = staged(asked.withColumn("entry", F.explode("entries")).drop("entries"))
    postings = staged(known.withColumn("entry", F.explode("entries")).drop("entries").join(asked.select(*on).distinct(), on, "left_semi"))
    many = postings.groupBy(*on).agg(F.count("*").alias("_n"))
    said = [c for c in asked.columns if c != "query_id"]
    rarest = asked.join(many, on, "left").groupBy("query_id").agg(F.min_by(F.struct(*said), F.struct(F.coalesce("_n", F.lit(0)), F.col("entry"))).alias("_q"))
    return rarest.select("query_id", "_q.*").join(postings, on).drop("entry")


def find_parts(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, q, text)``: the distinct ``text`` of ``texts`` that contain the ``q`` of each query; an empty one is in none."""
    known = texts.select("text").where("text is not null").distinct().withColumn("entries", part_entries(F.col("text")))
    asked = queries.where("q <> ''").select("query_id", "q", asked_entries(F.col("q")).alias("entries"))
    return candidates(known, asked, []).where(F.contains("text", F.col("q"))).select("query_id", "q", "text")
