"""Connected components by alternating large-star and small-star rounds.

Every round is two shuffles of the edges, written to the shared folder; links and labels stay distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.plans.scratch import save


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "large-star", n)
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = save(down.groupBy("a").agg(F.min("b").alias("m")), "small-star", n)
    rest = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b long, not null); root is the least node reachable.

    The rounds end when the edges no longer change, which happens after about log n of them. Loops are ignored.
    """
    n = edges.count()
    now = save(edges.where("a <> b").select("a", "b").distinct(), "edges", n)
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        large = save(_large_star(now, n), "edges-large", n)
        now = save(_small_star(large, n), "edges-small", n)
        new = _state(now)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b"), F.col("b")).distinct())
