"""Connected components of a table of links, by alternating large and small stars.

Each round points the neighbours of a node at the smallest of them; the links
become stars after few rounds, whatever the length of the chains. Links are
grouped with map-side minima and joined back; the minima of hubs, of which the
number of links bounds the count, are broadcast, so no task gathers a hub. Each
star is written, and so are its minima: a plan that held two stars would read the
links sixty times, and the driver would keep it in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm.shared import materialize


#: Nodes of more links than this are hubs; there are at most ``HUBS``, whose rows may be broadcast.
HUB_LINKS, HUBS = 1_000, 100_000


def split_join(rows: DataFrame, table: DataFrame, key: str, limit: int) -> DataFrame:
    """``rows`` joined with ``table(key, m, n)``; keys of over ``limit`` rows (``n``) are looked up where their rows lie.

    The callers choose ``limit`` so that no more than ``HUBS`` keys can pass it.
    """
    hubs = table.where(F.col("n") > limit).select(F.col(key), F.struct("m").alias("hub"))
    marked = rows.join(F.broadcast(hubs), key, "left")
    rest = marked.where("hub is null").drop("hub").join(table.where(F.col("n") <= limit).select(key, "m"), key)
    return marked.where("hub is not null").withColumn("m", F.col("hub.m")).drop("hub").unionByName(rest)


def hub_limit(rows: int) -> int:
    """Fewer than ``HUBS`` keys have more rows than this."""
    return max(HUB_LINKS, -(-rows // HUBS))


def _least_met(rows: DataFrame, least: DataFrame, limit: int) -> DataFrame:
    """``rows`` joined with the written ``least(u, m, n)``; without hubs this is a plain join."""
    hubs = least.where(F.col("n") > limit).limit(1).count()
    return split_join(rows, least, "u", limit) if hubs else rows.join(least.select("u", "m"), "u")


def _large_star(edges: DataFrame, limit: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
    met = _least_met(both.where("v > u"), least, limit)
    return materialize(met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "stars")


def _small_star(edges: DataFrame, limit: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    rest = _least_met(down, least, limit).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return materialize(least.select("u", F.col("m").alias("v")).union(rest).distinct(), "stars")


def connected_components(spark: SparkSession, links: DataFrame, nodes: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root, root_rank)`` for each row of ``nodes(node, rank)``: its component and the smallest rank in it.

    ``links`` holds two long columns; links of a node with itself and repeated
    links are ignored. Raises if the stars have not settled after ``max_rounds``.
    """
    u, v = links.columns[:2]
    edges = materialize(links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v"), "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    if before[0]:
        for _ in range(max_rounds):
            limit = hub_limit(2 * before[0])
            edges = _small_star(_large_star(edges, limit), limit)
            after = mark(edges)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"links have not settled after {max_rounds} rounds")
    roots = nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", "rank", F.coalesce("root", "node").alias("root"))
    roots = materialize(roots, "roots")
    ranks = materialize(roots.groupBy("root").agg(F.min("rank").alias("m"), F.count("*").alias("n")), "ranks")
    # Nodes of links bound the large components: they are as many as the last edges, and their roots.
    return split_join(roots, ranks, "root", hub_limit(2 * before[0])).select("node", "root", F.col("m").alias("root_rank"))
