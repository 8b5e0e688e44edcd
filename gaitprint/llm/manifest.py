"""Merkle dataset manifest (operator 12): a content-addressed tree over all rows, and a proof for every leaf.

Each language's leaves, in the order of doc_id, are the bottom of a tree of runs of eight; the languages' roots
are the leaves of one more tree.  The store holds records, digest to children, one table per level.  Proofs
come from the root: leaf requests descend by the digits (base 8) of their ranks, looking up the record of
the digest they stand at, taking one child and collecting the others.  Requests whose first digits agree
travel as one row until they part, so a level's frontier is as large as that level of the tree and no
digest is looked up by very many rows.  What was collected on the way down is then reversed.

All of it is DataFrame work: digests are Spark's ``sha2``, ranks come from a range partitioning by (language,
doc_id) and prefix sums over its parts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaitprint.llm.common import drop_tables, stage_table

DIGIT = 3  # bits of a rank's digit: runs of eight
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEVEL = ["branch", "rank", "n", "digest"]


def digest(c: Column) -> Column:
    """Lowercase hex sha256."""
    return F.sha2(c, 256)


def field(c: Column) -> Column:
    """A value with its length, ``-`` if null; so no two rows give the same bytes."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """The digest of a row's FIELDS, some of them changed."""
    return digest(F.concat(*[field(changed.get(n, F.col(n))) for n in FIELDS]))


def branch(lang: Column) -> Column:
    """A language as a key that isn't null and sorts by bytes, the null language first."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (with ``branch``) with rank, from 0 in ``order`` within each branch, and n, the branch's rows; as a table.

    Parts are cut by value, rows numbered within them, and each part's first rank is a prefix sum over parts.
    Rows that agree in ``order`` may be told apart by nothing, so a number of their own spreads them.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["branch", *order, "row_"]
    numbered = rows.withColumn("row_", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = stage_table(numbered.drop("row_").withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)), f"{name}-in-parts")
    each = placed.groupBy("branch", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("own"))
    within = Window.partitionBy("branch")
    # One row per part and branch: as many as there are tasks and branches, not rows.
    bases = each.select(
        "branch", "part", (F.coalesce(F.sum("own").over(within.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("base"), F.sum("own").over(within).alias("n")
    )
    out = stage_table(placed.join(bases, ["branch", "part"]).withColumn("rank", F.col("place") + F.col("base")).drop("part", "place", "base"), name)
    drop_tables(placed)
    return out


@dataclass
class Tree:
    """A tree per branch: ``levels[k]`` holds the nodes of height k + 1 (branch, rank, n of that height, digest, children)."""

    levels: list[DataFrame]
    roots: DataFrame  # branch, digest, height

    def records(self, height: int) -> DataFrame:
        """digest, children of the nodes of a height; equal digests are one record."""
        return self.levels[height - 1].select("digest", "children").dropDuplicates(["digest"])


def grown(leaves: DataFrame, name: str) -> Tree:
    """The trees over ``leaves`` (branch, rank, n, digest), level by level: every eight nodes become one while a branch has several."""
    level, levels, done = leaves.select(*_LEVEL), [], []
    while True:
        done.append(level.where("n = 1").select("branch", "digest", F.lit(len(levels)).alias("height")))
        if not level.where("n > 1").limit(1).count():
            return Tree(levels, reduce(DataFrame.union, done))
        runs = level.where("n > 1").groupBy("branch", F.shiftright("rank", DIGIT).alias("rank"), F.ceil(F.col("n") / (1 << DIGIT)).alias("n"))
        children = F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"])
        level = stage_table(runs.agg(children.alias("children")).withColumn("digest", digest(F.array_join("children", ""))), f"{name}-{len(levels) + 1}")
        levels.append(level)


@dataclass
class Manifest:
    """The store: leaves with their places, one tree per language and the tree over the languages' roots."""

    spark: SparkSession
    leaves: DataFrame  # branch, rank, n, digest, and what was carried along
    languages: Tree
    branches: DataFrame  # branch, place of the language, digest (its root), height
    top: Tree
    root: str | None

    def drop(self) -> None:
        """Delete the store's tables."""
        drop_tables(self.leaves, self.branches, *self.languages.levels, *self.top.levels)


def build(docs: DataFrame, **carried: Column) -> Manifest:
    """The manifest of all rows of ``docs`` (``doc_id``, ``source``, ``lang``, ``n_chars``, ``text``); ``carried`` are further columns kept with the leaves.

    Null doc_ids come first; rows of one doc_id are ordered by their digests, and equal rows are leaves each.
    """
    narrow = stage_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), branch(F.col("lang")).alias("branch"), leaf_digest().alias("digest"), *[c.alias(n) for n, c in carried.items()]), "leaf-digests")
    leaves = ranked(narrow, ["doc_id", "digest"], "leaves")
    drop_tables(narrow)
    languages = grown(leaves, "nodes")
    roots = languages.roots.select(F.lit("").alias("branch"), F.col("branch").alias("language"), "digest", F.col("height").alias("own_height"))
    placed = ranked(roots, ["language"], "languages")
    top = grown(placed, "top-nodes")
    root = top.roots.first()
    branches = placed.select(F.col("language").alias("branch"), F.col("rank").alias("place"), "digest", F.col("own_height").alias("height"))
    branches.staged_at = placed.staged_at
    return Manifest(docs.sparkSession, leaves, languages, branches, top, root["digest"] if root else None)


def _step(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """Every row of the frontier at each child of its digest, with the other children as one more segment of its path."""
    at = frontier.join(records, "digest").select(*[c for c in frontier.columns if c != "digest"], "children", F.posexplode("children").alias("digit", "child"))
    return at.select(*[F.col(c) for c in frontier.columns if c not in ("digest", "prefix", "path")], F.col("child").alias("digest"), (F.shiftleft("prefix", DIGIT) + F.col("digit")).alias("prefix"), _further("digit").alias("path"))


def _further(digit: str) -> Column:
    """The path with the children before and after a digit (1 for the whole of ``children`` but that one)."""
    joined = lambda lo, n: F.array_join(F.slice("children", lo, n), "")
    d = F.col(digit)
    return F.concat("path", F.array(F.struct(joined(F.lit(1), d).alias("before"), joined(d + 2, F.greatest(F.size("children") - d - 1, F.lit(0))).alias("after"))))


def proofs(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """Of the requested leaves (branch, rank, distinct; all if not given): the leaf's columns, subroot, and path.

    path is what stands beside the leaf's ancestors, from the leaf's own run to the root's: per level the digests before
    and after the one that is taken, as text.  Runs of one, and trees of one node, add nothing to the proof.
    """
    start = m.spark.sql("SELECT '' AS digest, 0L AS prefix").select(F.lit(m.root).alias("digest"), "prefix", F.expr("CAST(array() AS array<struct<before: string, after: string>>)").alias("path"))
    wanted = None if requests is None else stage_table(requests.select("branch", "rank"), "requests")
    height = len(m.top.levels)
    for h in range(height, 0, -1):
        start = _step(start, m.top.records(h))
    # Languages whose root was reached stand at height h of their own trees.
    at_root = start.select(F.col("prefix").alias("place"), "path").join(m.branches, "place").select("branch", F.col("digest").alias("subroot"), "digest", F.lit(0).cast("long").alias("prefix"), "path", "height")
    frontier = None
    for h in range(len(m.languages.levels), 0, -1):
        new = at_root.where(F.col("height") == h).drop("height")
        frontier = new if frontier is None else frontier.union(new)
        if wanted is not None:
            some = wanted.select("branch", F.shiftright("rank", DIGIT * h).alias("prefix")).distinct()
            frontier = frontier.join(some, ["branch", "prefix"], "left_semi")
        if h > 1:
            frontier = _step(frontier, m.languages.records(h))
            continue
    lone = at_root.where("height = 0").select("branch", "subroot", "prefix", F.lit(None).cast("array<string>").alias("children"), "path")
    runs = lone
    if frontier is not None:
        runs = frontier.join(m.languages.records(1), "digest").select("branch", "subroot", "prefix", "children", "path").union(lone)
    leaves = m.leaves if wanted is None else m.leaves.join(wanted, ["branch", "rank"], "left_semi")
    leaves = leaves.withColumns({"prefix": F.shiftright("rank", DIGIT), "digit": F.col("rank").bitwiseAND((1 << DIGIT) - 1).cast("int")})
    met = leaves.join(runs, ["branch", "prefix"])
    path = F.when(F.col("children").isNull(), F.col("path")).otherwise(_further("digit"))
    return met.withColumn("path", F.reverse(path)).drop("children", "prefix", "digit")


def proof_digest(path: str = "path") -> Column:
    """The digest of a path's digests from leaf to root."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""))


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, leaf, lambda acc, x: digest(F.concat(x["before"], acc, x["after"])))


def tampered(doc_id: str = "doc_id") -> Column:
    """Whether a row is tampered with in the test of proofs: 3 divides the crc32 of its id as text (never for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 3 == 0, F.lit(False))


def verified_leaves(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    A third of the rows (:func:`tampered`) is checked with the letters A-Z of its text lower-cased; folded_root
    is what that leaf and the original siblings give, and verified is whether it is the root.  Nulls in any
    column are values of their own; a null text can't be tampered with.  An empty table gives no rows.
    """
    changed = F.when(tampered(), leaf_digest(text=F.translate("text", UPPER, LOWER)))
    m = build(docs, changed=changed)
    told = proofs(m).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(m.root).cast("string").alias("root"), proof_digest().alias("proof_sha256"), folded(F.coalesce("changed", "digest")).alias("folded_root")
    )
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
