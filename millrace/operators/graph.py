"""Follower graphs as edge frames (``u`` follows ``v``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage


def follower_top(edges: DataFrame, n: int = 100) -> DataFrame:
    """``followee`` and ``count`` of the ``n`` most followed, equal counts by name.  Repeated edges count each; a null follower counts nothing."""
    counts = edges.groupBy(F.col("v").alias("followee")).agg(F.count("u").alias("count"))
    return counts.orderBy(F.desc("count"), "followee").limit(n)


def follower_top_sql(edges: DataFrame, n: int = 100) -> DataFrame:
    """:func:`follower_top` as SQL text over the edges, named by a parameter rather than a view of the session."""
    text = "SELECT v AS followee, count(u) AS count FROM {edges} GROUP BY v ORDER BY count DESC, followee LIMIT {n}"
    return edges.sparkSession.sql(text, edges=edges, n=n)


def degrees(edges: DataFrame) -> DataFrame:
    """``node``, ``out_degree``, ``in_degree`` over distinct edges."""
    ends = edges.select("u", "v").distinct().select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("v").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def nodes(edges: DataFrame) -> DataFrame:
    """Every node once: ``node``."""
    return edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).where("node IS NOT NULL").distinct()


def dangling(edges: DataFrame) -> DataFrame:
    """Nodes that follow nobody.  Both sides are distinct first: a node of a third of all edges is one row a task."""
    return edges.select(F.col("v").alias("node")).where("node IS NOT NULL").distinct().join(edges.select(F.col("u").alias("node")).distinct(), "node", "left_anti")


def unfollowed(edges: DataFrame) -> DataFrame:
    """Nodes nobody follows."""
    return edges.select(F.col("u").alias("node")).where("node IS NOT NULL").distinct().join(edges.select(F.col("v").alias("node")).distinct(), "node", "left_anti")


def adjacency(edges: DataFrame) -> DataFrame:
    """``node`` and ``follows``, a sorted array; for reports, as no operator here needs the lists."""
    return edges.distinct().groupBy(F.col("u").alias("node")).agg(F.sort_array(F.collect_list("v")).alias("follows"))


def pagerank(edges: DataFrame, iterations: int = 10, damping: float = 0.85, most_edges: int = 1_000_000) -> DataFrame:
    """``node`` and ``rank``; ranks sum to 1.

    Edges are made distinct and nulls left out.  Each round is
    (1 - damping)/n + damping * (what followers give + the dangling nodes' even
    share).  Edges, with their source's degree, and every round's ranks are
    written to the checkpoint folder, edges partitioned by source and ranks by
    node: a round shuffles ranks and what followers give, never the edges, and
    costs the same however many went before it.  A source of more than
    ``most_edges`` edges is spread over several partitions, each with a copy of
    its rank.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = edges.where("u IS NOT NULL AND v IS NOT NULL").select("u", "v").distinct()
    out = links.groupBy("u").agg(F.count(F.lit(1)).alias("degree")).withColumn("copies", F.ceil(F.col("degree") / most_edges).cast("int"))
    weighted = cut_lineage(links.join(out, "u").select("u", F.pmod(F.xxhash64("v"), F.col("copies")).cast("int").alias("part"), "v", "degree").repartition(parts, "u", "part"))
    ranks = cut_lineage(nodes(weighted).join(out.select(F.col("u").alias("node"), "copies"), "node", "left").repartition(parts, "node"))
    n = ranks.count()
    if not n:
        return ranks.select("node", F.lit(0.0).alias("rank"))
    ranks = ranks.withColumn("rank", F.lit(1.0 / n))
    for _ in range(iterations):
        # a subquery rather than a literal: the same code then serves every round
        lost = ranks.where("copies IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).scalar()
        giving = ranks.where("copies IS NOT NULL").select(F.col("node").alias("u"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"), "rank")
        given = weighted.join(giving, ["u", "part"]).groupBy(F.col("v").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("given"))
        base = F.lit((1 - damping) / n) + lost * F.lit(damping / n)
        ranks = cut_lineage(ranks.select("node", "copies").join(given, "node", "left").select("node", "copies", (base + F.lit(damping) * F.coalesce("given", F.lit(0.0))).alias("rank")))
    return ranks.select("node", "rank")
