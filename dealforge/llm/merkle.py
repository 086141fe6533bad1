"""A Merkle manifest of a table: one tree per source, a tree over their roots, and proofs of rows.

A row is a leaf, the digest of its fields with their lengths. Within a source leaves ascend by id;
every ``RUN`` consecutive nodes become their digest until one remains, the source's subroot. The
subroots in order of their sources become the root in the same way.

Records of digest to children are kept by content: what stands below a digest is found by the
digest alone. ``LEVELS`` levels make a page, stored under its top digest, so that a tree of 81 ** k
leaves is k tables and a descent is k joins. Leaf requests start together at the root and go down
by the digits of their ranks: at each page a request leaves the unselected children of its runs in
its path, from the top down; the finished path reversed is the proof from leaf to root. A page is
visited once whatever the number of requests below it. Proof and claim are folded in the row in
which the descent ends, so paths of leaves are never shuffled.

Cases: null fields are told from empty ones; a null source is a source of its own, first in order;
null ids come first; rows with one id follow by digest, and equal rows are leaves of their own;
an empty table has no root and gives no rows; texts are digested whole whatever their length;
columns that are not among the fields play no part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import saved
from .ordering import positions

RUN, LEVELS = 3, 4
PAGE = RUN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<at: int, others: array<string>>>"


def field(c: Column) -> Column:
    """A value with its length in UTF-8 bytes, or a sign that there is none."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _parents(nodes: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(nodes), F.lit(RUN)), lambda i: F.sha2(_joined(F.slice(nodes, i, RUN)), 256))


def _levels(nodes: Column, alone: Column) -> Column:
    """The page's levels from its children up. A page that is the whole tree ends where one node remains."""

    def grow(levels, _):
        last = F.element_at(levels, -1)
        return F.when(alone & (F.size(last) == 1), levels).otherwise(F.concat(levels, F.array(_parents(last))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.array(nodes), grow)


def _segments(levels: Column, child: Column) -> Column:
    """Of each level of a page, from the children up: the child's place in its run, and the others there."""
    steps = F.array(*[F.lit(RUN**k) for k in range(LEVELS)])

    def segment(k):
        nodes, at = levels[k], F.floor(child / steps[k]).cast("int")
        digit = at % RUN
        others = F.concat(F.slice(nodes, at - digit + 1, digit), F.slice(nodes, at + 2, F.lit(RUN - 1) - digit))
        return F.struct(digit.alias("at"), others.alias("others"))

    ks = F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: k < F.size(levels) - 1)
    return F.transform(ks, segment).cast(PATH)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path, from leaf to root, lead to."""
    join = lambda acc, s: F.sha2(F.concat(_joined(F.slice(s["others"], 1, s["at"])), acc, _joined(F.slice(s["others"], s["at"] + 1, RUN))), 256)
    return F.aggregate(path, digest, join)


def proof_digest(path: Column) -> Column:
    return F.sha2(_joined(F.flatten(F.transform(path, lambda s: s["others"]))), 256)


@dataclass
class Forest:
    """``pages[h - 1]`` holds the pages of height h; ``tops`` (grp, height, digest) where each group's tree ends."""

    pages: list[DataFrame]
    tops: DataFrame


def forest(nodes: DataFrame) -> Forest:
    """Pages over ``nodes`` (grp, pos, n, digest), n being the group's number of nodes."""
    pages, tops, kind = [], [], nodes.schema["grp"].dataType
    left = nodes
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        page = left.groupBy("grp", "n", F.floor(F.col("pos") / PAGE).alias("page")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("nodes"))
        page = page.select("grp", "n", "page", _levels(F.col("nodes.digest"), F.col("n") <= PAGE).alias("levels"))
        page = saved(page.withColumn("digest", F.element_at(F.element_at("levels", -1), 1)), "merkle-pages")
        pages.append(page)
        tops.append(page.where(F.col("n") <= PAGE).select(F.col("grp").cast(kind), F.lit(len(pages)).alias("height"), "digest"))
        if most <= PAGE:
            break
        left = page.where(F.col("n") > PAGE).select("grp", F.col("page").alias("pos"), F.ceil(F.col("n") / PAGE).alias("n"), "digest")
        most = -(-most // PAGE)
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return Forest(pages, out)


@dataclass
class Manifest:
    leaves: DataFrame  # grp, pos, id, leaf and what came with the row
    below: Forest  # a tree per source
    sources: DataFrame  # grp, pos, height, digest: the subroots in order
    above: Forest  # the tree over them


def build(rows: DataFrame) -> Manifest:
    """The manifest of ``rows`` (grp, id, leaf; further columns stay with the leaves)."""
    leaves = saved(positions(rows, ["id", "leaf"], by=("grp",)), "merkle-leaves")
    below = forest(leaves.select("grp", "pos", "n", F.col("leaf").alias("digest")))
    sources = saved(positions(below.tops, ["grp"]), "merkle-sources")
    above = forest(sources.select(F.lit(0).alias("grp"), "pos", "n", "digest"))
    return Manifest(leaves, below, sources, above)


def _down(frontier: DataFrame, page: DataFrame, asked: DataFrame) -> DataFrame:
    """From each page of the frontier (grp, page, digest, path) to its asked children (``item.child``)."""
    record = page.select(F.col("digest").alias("_top"), "levels").dropDuplicates(["_top"])
    asked = asked.select(F.col("grp").alias("_grp"), F.col("page").alias("_page"), "items")
    at = frontier.join(record, F.col("digest") == F.col("_top"))
    at = at.join(asked, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("page") == F.col("_page")))
    at = at.drop("_top", "_grp", "_page").withColumn("item", F.explode("items"))
    child = F.col("item.child")
    path = F.concat("path", F.reverse(_segments(F.col("levels"), child)))
    return at.select("grp", (F.col("page") * PAGE + child).alias("page"), F.element_at(F.element_at("levels", 1), child + 1).alias("digest"), path.alias("path"), "item", *[c for c in ("subroot", "root") if c in frontier.columns])


def _asked(wanted: DataFrame, heights: int) -> list[DataFrame]:
    """For each height, which children of which pages requests go through; ``wanted`` has grp, pos and item fields."""
    child = (F.col("pos") % PAGE).cast("int").alias("child")
    rest = [c for c in wanted.columns if c not in ("grp", "pos")]
    by = lambda d, item: d.groupBy("grp", F.floor(F.col("pos") / PAGE).alias("page")).agg(F.collect_list(item).alias("items"))
    out = [by(wanted, F.struct(child, *rest))]
    for _ in range(1, heights):
        out.append(by(out[-1].select("grp", F.col("page").alias("pos")), F.struct(child)))
    return out


def prove(m: Manifest, requests: DataFrame) -> DataFrame:
    """Proofs of the leaves that ``requests`` (grp, pos, claim and further columns) name, each place at most once.

    Rows ``(item, leaf, subroot, root, path)``: ``item`` has the request's columns, ``path`` leads
    from the leaf to the root. ``folded(claim, path)`` equals ``root`` if the claim is the leaf.
    """
    groups = requests.select("grp").distinct().withColumnRenamed("grp", "_g")
    wanted = m.sources.join(groups, F.col("grp").eqNullSafe(F.col("_g"))).select(F.lit(0).alias("grp"), "pos", F.col("grp").alias("source"), "height")
    at = m.above.tops.select("grp", F.lit(0).cast("long").alias("page"), "digest", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    asked = _asked(wanted, len(m.above.pages))
    for h in range(len(m.above.pages), 0, -1):
        at = _down(at, m.above.pages[h - 1], asked[h - 1])
    start = at.select(F.col("item.source").alias("grp"), F.col("item.height").alias("height"), F.lit(0).cast("long").alias("page"), "digest", "path", F.col("digest").alias("subroot"), "root")
    start = saved(start, "merkle-descent")
    asked, at = _asked(requests, len(m.below.pages)), None
    for h in range(len(m.below.pages), 0, -1):
        here = start.where(F.col("height") == h).drop("height")
        at = _down(here if at is None else here.unionByName(at.drop("item")), m.below.pages[h - 1], asked[h - 1])
    return at.select("item", F.col("digest").alias("leaf"), "subroot", "root", F.reverse("path").alias("path"))


def audit(df: DataFrame, changed: dict[str, Column] | None = None, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Every row's leaf, subroot, root and proof, and whether its present content still folds to the root.

    ``changed`` gives columns as they are found now; the manifest is of the rows as they were.
    Rows ``(id, leaf, subroot, root, proof_sha256, folded_root, verified)``.
    """
    col = lambda c: F.col(f"`{c}`")
    now = [(changed or {}).get(c, col(c)) for c in fields]
    rows = df.select(col(source_col).alias("grp"), col(id_col).alias("id"), leaf([col(c) for c in fields]).alias("leaf"), leaf(now).alias("claim"))
    m = build(rows)
    got = prove(m, m.leaves.select("grp", "pos", "id", "claim"))
    got = got.withColumn("folded_root", folded(F.col("item.claim"), F.col("path")))
    return got.select("item.id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
