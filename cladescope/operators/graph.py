"""Graph clustering on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladescope.storage import shared_dir


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges``.

    Self edges keep isolated nodes; null ends are dropped.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    stars = contract(pairs, "a", "b", most_rounds)
    rest = stars.select(F.col("component").alias("node")).unionByName(pairs.where("a = b").select(F.col("a").alias("node"))).distinct()
    rest = rest.join(stars.select(F.col("node").alias("known")), F.col("node") == F.col("known"), "left_anti")
    return stars.unionByName(rest.select("node", F.col("node").alias("component")))


def contract(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` but those smallest ones; checkpointed.

    Alternating star contraction: a large star links each larger neighbour to a
    node's smallest one, a small star does so for the smaller neighbours. A star
    deals the edges by node once; the minima and the edges that they meet read the
    same exchange. Rounds grow with the logarithm of the longest path.
    """
    shared_dir(edges.sparkSession)
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    # columns that can't be null keep both readers of an exchange alike
    blank = F.lit("" if dict(pairs.dtypes)["a"] == "string" else 0)
    solid = lambda x: F.coalesce(x("a", "b"), blank.cast(dict(pairs.dtypes)["a"]))
    stars = pairs.select(solid(F.greatest).alias("a"), solid(F.least).alias("b")).distinct().checkpoint()
    before = None
    for _ in range(most_rounds):
        state = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            # converged: every node but the roots points at its component's smallest node
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
        stars = _small_star(_large_star(stars)).distinct().checkpoint()
    raise RuntimeError(f"no convergence in {most_rounds} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    """One row for each edge; the same edge may come twice."""
    turned = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = edges.select(F.explode(turned).alias("e")).select("e.a", "e.b").repartition(F.col("a"))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    # the smallest is no larger than a: as a condition on it, b > a stays above the exchange that both sides read
    return both.join(least, F.col("a") == F.col("u")).where(F.col("b") > F.greatest("a", "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    dealt = edges.repartition(F.col("a"))
    least = dealt.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = dealt.join(least, F.col("a") == F.col("u"))
    # the row of the smallest neighbour stays, every other links its smaller end to that neighbour
    return met.select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))
