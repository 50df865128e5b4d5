"""A Merkle manifest of a table: levels built bottom-up, proofs pushed top-down, and folding of proofs.

The rows of each group (a language) are the leaves of a tree; the roots of the groups are the leaves of one tree above.

1. Leaves get their places without a task that holds a whole tree: they are dealt by ranges of (tree, order), counted by range,
   and numbered within a range from the count of the ranges before.
2. From the bottom up, a node is the digest of the digests of up to `FAN` consecutive children, and its row holds these. A level
   is a grouping by place / FAN of the one below and a written table; a tree ends with the level where it has one node.
3. From the top down, a level's nodes are joined with the proof suffixes that they inherit; each child puts its siblings (those
   before it and those after it) in front of its parent's suffix. Leaves meet their proofs once, in the last step.
4. `folded` recomputes a root from a digest and its proof.

A level shuffles an eighth of the one below, no text is shuffled, and the driver sees only the greatest place of a leaf.

Null orders come first. Rows that tie in the order are placed by digest; equal rows are interchangeable, so roots don't depend
on the partitioning. Null groups are one tree, in front of the others, which go by UTF-8 bytes. An empty table has no rows, and
so no root. Columns that `manifest` isn't told of don't pass, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoplate.llm.common import dropped, written

FAN = 8


def field(value: Column) -> Column:
    """UTF-8 byte count, a colon and the value as text; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Lowercase hex sha256 of the fields of a row."""
    return F.sha2(F.concat(*map(field, values)), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, digest, lambda d, p: F.sha2(F.concat(p.before, d, p.after), 256))


def proof_text(proof: Column) -> Column:
    """The siblings of a proof, concatenated level by level from left to right."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p.before, p.after)), "")


def _numbered(leaves: DataFrame) -> DataFrame:
    """A written table of (tree, order, digest, row) with `place` bigint, from 0 in each tree by (order, digest)."""
    by = ["order", "digest", "_row"]  # the row number deals many equal rows to several ranges
    cut = written(leaves.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange("tree", *by).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = cut.groupBy("tree", "_range").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    inside = cut.withColumn("_inside", F.row_number().over(Window.partitionBy("tree", "_range").orderBy(*by)))
    both = inside.join(offsets, ["tree", "_range"]).withColumn("place", F.col("_before") + F.col("_inside") - 1)
    out = written(both.select("tree", "place", "digest", "row"), "placed")
    dropped(cut)
    return out


class Forest:
    """Trees over leaves (tree, order, digest, row): `tree` is never null, and `row` rides along with a leaf."""

    def __init__(self, leaves: DataFrame):
        self.placed = _numbered(leaves)
        self.last = written(self.placed.groupBy("tree").agg(F.max("place").alias("last")), "sizes")
        self.levels: list[DataFrame] = []
        below, most = self.placed, self.last.agg(F.max("last")).first()[0] or 0
        while most >= FAN ** len(self.levels):
            growing = below.join(self.last.filter(F.col("last") >= FAN ** len(self.levels)).select("tree"), "tree", "left_semi")
            kid = F.struct((F.col("place") % FAN).cast("int").alias("at"), "digest", *(["row"] if not self.levels else []))
            nodes = growing.groupBy("tree", F.floor(F.col("place") / FAN).alias("place")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
            below = written(nodes.withColumn("digest", F.sha2(F.array_join("kids.digest", ""), 256)), f"level{len(self.levels)}")
            self.levels.append(below)

    def _tops(self, level: int) -> DataFrame:
        """Trees whose root is in a level; those of a single leaf have theirs in level -1."""
        least = FAN**level if level >= 0 else 0
        return self.last.filter((F.col("last") >= least) & (F.col("last") < FAN ** (level + 1))).select("tree")

    def roots(self) -> DataFrame:
        """(tree, digest)"""
        out = self.placed.join(self._tops(-1), "tree", "left_semi").select("tree", "digest")
        for i, level in enumerate(self.levels):
            out = out.unionByName(level.filter("place = 0").join(self._tops(i), "tree", "left_semi").select("tree", "digest"))
        return out

    def proofs(self, inherited: DataFrame) -> DataFrame:
        """(tree, digest, row, proof) of each leaf. inherited: (tree, proof), what each root's proof is."""
        above = None
        for i in range(len(self.levels) - 1, -1, -1):
            tops = inherited.join(self._tops(i), "tree", "left_semi").select("tree", F.lit(0).cast("bigint").alias("place"), "proof")
            nodes = self.levels[i].select("tree", "place", "kids").join(tops if above is None else above.unionByName(tops), ["tree", "place"])
            each = nodes.select("tree", F.col("place").alias("parent"), "kids", "proof", F.posexplode("kids").alias("k", "kid"))
            digests = F.col("kids.digest")
            own = F.struct(
                F.array_join(F.slice(digests, F.lit(1), F.col("k")), "").alias("before"),
                F.array_join(F.slice(digests, F.col("k") + 2, F.lit(FAN)), "").alias("after"),
            )
            proof = F.concat(F.array(own), "proof").alias("proof")
            if i:
                above = each.select("tree", (F.col("parent") * FAN + F.col("k")).alias("place"), proof)
            else:
                above = each.select("tree", "kid.digest", "kid.row", proof)
        single = self.placed.join(self._tops(-1), "tree", "left_semi").join(inherited, "tree").select("tree", "digest", "row", "proof")
        return single if above is None else above.unionByName(single)


def manifest(rows: DataFrame, digest: Column, group: Column, order: list[Column], carry: list[Column]) -> DataFrame:
    """`carry` columns, `leaf`, `subroot`, `root` and `proof` array<struct<before,after>> of every row.

    digest: hex digest of a row; group: string column, a tree each; order: of leaves in a tree."""
    named = [c.alias(f"_{i}") for i, c in enumerate(order)]
    tree = F.struct(group.isNotNull().alias("known"), F.coalesce(group, F.lit("")).alias("name"))
    leaves = written(rows.select(tree.alias("tree"), F.struct(*named).alias("order"), digest.alias("digest"), F.struct(*carry).alias("row")), "leaves")
    lower = Forest(leaves)
    subroots = lower.roots().select(F.lit(0).alias("tree"), F.col("tree").alias("order"), "digest", F.struct("tree", F.col("digest").alias("subroot")).alias("row"))
    upper = Forest(written(subroots, "subroots"))
    empty = F.array().cast("array<struct<before:string,after:string>>").alias("proof")
    root = upper.roots().select("tree", F.col("digest").alias("root"), empty)
    tops = upper.proofs(root.select("tree", "proof")).join(root.select(F.col("tree").alias("all"), "root"), F.col("tree") == F.col("all"))
    trees = written(tops.select(F.col("row.tree").alias("tree"), "row.subroot", "root", "proof"), "trees")
    proved = lower.proofs(trees.select("tree", "proof")).join(trees.select("tree", "subroot", "root"), "tree")
    return proved.select("row.*", F.col("digest").alias("leaf"), "subroot", "root", "proof")
