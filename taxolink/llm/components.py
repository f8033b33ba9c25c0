"""Connected components of a link table by repeated contraction, as Spark joins.

Each round hooks every node to its smallest neighbour (or itself), rewrites the links to the hooked nodes and drops
links that became loops. Odd rounds compare ids, so stars around their smallest node end in one round; even rounds
compare seeded hashes of the ids, which halves the nodes of any graph in expectation, long chains included. Every round
is written to the shared folder; links and components never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolink.session import write_and_read


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (columns ``a``, ``b``, longs): equal roots, same component.

    Nulls and loops are ignored; repeated links are harmless.
    """
    links = write_and_read(links.select("a", "b").filter("a <> b").distinct(), "cc-links")
    roots = None
    turn = 1
    while not links.isEmpty():
        rank = (lambda c: c) if turn % 2 else (lambda c: F.xxhash64(F.lit(turn), c))  # noqa: B023
        both = links.union(links.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min(F.struct(rank(F.col("b")).alias("rank"), F.col("b").alias("node"))).alias("m"))
        own = F.struct(rank(F.col("a")).alias("rank"), F.col("a").alias("node"))
        hooks = write_and_read(hooks.select(F.col("a").alias("from"), F.least(F.col("m"), own)["node"].alias("to")),
                               "cc-hooks")
        links = write_and_read(
            links.join(hooks, F.col("a") == F.col("from")).select(F.col("to").alias("a2"), "b")
            .join(hooks, F.col("b") == F.col("from")).select(F.col("a2").alias("a"), F.col("to").alias("b"))
            .filter("a <> b").distinct(), "cc-links")
        if roots is None:
            roots = hooks.select(F.col("from").alias("node"), F.col("to").alias("root"))
        else:
            roots = write_and_read(
                roots.join(hooks, F.col("root") == F.col("from"), "left")
                .select("node", F.coalesce("to", "root").alias("root")), "cc-roots")
        turn += 1
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
