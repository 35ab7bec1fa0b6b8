"""Connected components of a link table: a distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.arrow import map_columns
from cohortwise.session import materialize


def _spanning(edges: DataFrame) -> DataFrame:
    """Union-find inside each partition: its links become at most one link (node, root) per node."""

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for u, v in zip(batch["u"], batch["v"]):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        stars = [(x, top) for x in parent if (top := root(x)) != x]
        for i in range(0, len(stars), 50_000):
            us, vs = zip(*stars[i : i + 50_000])
            yield {"u": list(us), "v": list(vs)}

    return map_columns(edges.select("u", "v"), kernel, "u bigint, v bigint")


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node still has two parents, or a parent that has a parent itself."""
    child = edges.select(F.col("u").alias("x"), F.col("v").alias("p"))
    parent = edges.select(F.col("v").alias("x"), F.lit(None).cast("bigint").alias("p"))
    seen = child.unionByName(parent).groupBy("x").agg(
        F.min("p").alias("low"), F.max("p").alias("high"), F.max(F.col("p").isNull()).alias("above")
    )
    return not seen.filter("low != high or (above and low is not null)").isEmpty()


def components(links: DataFrame, tag: str) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the smallest node reachable.

    Large-star and small-star steps alternate with contraction inside the partitions until every node hangs on its
    root, which takes a logarithmic number of rounds. Each round is written to the shared folder. A hub's links are
    joined, never gathered, so the planner can split them. Null ends and links of a node with itself are left out;
    no links give no rows.
    """
    ends = links.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = materialize(_spanning(ends.filter("u != v")), tag)
    while _unfinished(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("of"), "m")
        large = both.join(least, F.col("u") == F.col("of")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), "m")
        small = large.join(lower, F.col("u") == F.col("of")).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        )
        edges = materialize(_spanning(small.select("e.*").filter("u != v")), tag)
    pairs = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root"))))
    return edges.select(pairs.alias("p")).select("p.*").distinct()
