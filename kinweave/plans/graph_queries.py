"""Graph operations over family trees, claims and flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import graph
from kinweave.plans.registry import query
from kinweave.sources.domain import relation, with_relations

UND = ", u AS (SELECT parent_id AS a, child_id AS b FROM parent_of UNION SELECT child_id, parent_id FROM parent_of)"


def roots(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id long")


def up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "parent_of").select(F.col("child_id").alias("a"), F.col("parent_id").alias("b"))


def down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "parent_of").select(F.col("parent_id").alias("a"), F.col("child_id").alias("b"))


@query("bounded_bfs_component", with_relations(UND + """, r AS (SELECT CAST(20 AS BIGINT) AS id, 0 AS depth UNION SELECT b, depth + 1 FROM r JOIN u ON a = id WHERE depth < 3),
n AS (SELECT id, CAST(min(depth) AS INT) AS depth FROM r GROUP BY id) SELECT id, depth, count(*) OVER () > 30 AS truncated FROM n QUALIFY row_number() OVER (ORDER BY depth, id) <= 30""", "parent_of", recursive=True))
def bounded_bfs_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bounded_bfs(graph.undirected(relation(spark, sf_dir, "parent_of"), "parent_id", "child_id"), roots(spark, 20), 3, cap=30)


@query("component_edges", with_relations(UND + """, r AS (SELECT CAST(20 AS BIGINT) AS id, 0 AS depth UNION SELECT b, depth + 1 FROM r JOIN u ON a = id WHERE depth < 2)
SELECT edge_id, parent_id, child_id, status FROM parent_of WHERE parent_id IN (SELECT id FROM r) AND child_id IN (SELECT id FROM r)""", "parent_of", recursive=True))
def component_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = relation(spark, sf_dir, "parent_of")
    nodes = graph.bounded_bfs(graph.undirected(e, "parent_id", "child_id"), roots(spark, 20), 2)
    return graph.inner_edges(e, nodes, "parent_id", "child_id").select("edge_id", "parent_id", "child_id", "status")


FRONTIER = ", r AS (SELECT x::BIGINT AS id, 0 AS depth FROM unnest([100, 121, 149]) AS t(x) UNION SELECT parent_id, depth + 1 FROM r JOIN parent_of ON child_id = id WHERE depth < 3), n AS (SELECT id, CAST(min(depth) AS INT) AS depth FROM r GROUP BY id)"


@query("ancestor_frontier", with_relations(FRONTIER + " SELECT id, depth, false AS truncated FROM n", "parent_of", recursive=True))
def ancestor_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bounded_bfs(up(spark, sf_dir), roots(spark, 100, 121, 149), 3)


@query("frontier_by_depth", with_relations(FRONTIER + " SELECT depth, count(*) AS nodes FROM n GROUP BY depth", "parent_of", recursive=True))
def frontier_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestor_frontier(spark, sf_dir).groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))


@query("relationship_impact", with_relations(", r AS (SELECT CAST(7 AS BIGINT) AS id, 0 AS depth UNION SELECT child_id, depth + 1 FROM r JOIN parent_of ON parent_id = id WHERE depth < 3) SELECT id, CAST(min(depth) AS INT) AS depth, false AS truncated FROM r GROUP BY id", "parent_of", recursive=True))
def relationship_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hangs below an edge's child, which is at depth 0."""
    child = relation(spark, sf_dir, "parent_of").where("edge_id = 7").select(F.col("child_id").alias("id"))
    return graph.bounded_bfs(down(spark, sf_dir), child, 3)


PATHS = UND + ", p AS (SELECT [CAST(40 AS BIGINT)] AS path UNION ALL SELECT list_append(path, b) FROM p JOIN u ON a = path[-1] WHERE len(path) <= {0} AND NOT list_contains(path, b))"


@query("shortest_paths", with_relations(PATHS.format(4) + " SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INT) AS hops FROM p WHERE path[-1] = 43 AND len(path) = (SELECT min(len(path)) FROM p WHERE path[-1] = 43) ORDER BY path LIMIT 5", "parent_of", recursive=True))
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple paths of the least length between two people, five at most."""
    found = graph.walks(graph.undirected(relation(spark, sf_dir, "parent_of"), "parent_id", "child_id").distinct(), roots(spark, 40), 4).where(F.element_at("path", -1) == 43)
    sized = found.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("hops"))
    return sized.where(F.col("hops") == sized.agg(F.min("hops")).scalar()).orderBy("path").limit(5)


@query("source_entities", with_relations(" SELECT source, side, entity_id, min(claim_id) AS claim_id FROM (SELECT order_id % 20 AS source, 'subject' AS side, subject_id AS entity_id, claim_id FROM claims UNION ALL SELECT order_id % 20, 'object', object_id, claim_id FROM claims) GROUP BY ALL", "claims"))
def source_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that each source speaks of, by side, each with its first claim."""
    sides = F.explode(F.array(F.struct(F.lit("subject").alias("side"), F.col("subject_id").alias("entity_id")), F.struct(F.lit("object").alias("side"), F.col("object_id").alias("entity_id"))))
    return relation(spark, sf_dir, "claims").select((F.col("order_id") % 20).alias("source"), "claim_id", sides.alias("s")).groupBy("source", "s.side", "s.entity_id").agg(F.min("claim_id").alias("claim_id"))


@query("migration_chains", with_relations(", p AS (SELECT DISTINCT [from_id] AS path FROM flows UNION ALL SELECT list_append(path, to_id) FROM p JOIN flows ON from_id = path[-1] WHERE len(path) <= 2 AND NOT list_contains(path, to_id)) SELECT array_to_string(path, '>') AS chain, CAST(len(path) - 1 AS INT) AS steps FROM p WHERE len(path) > 1", "flows", recursive=True))
def migration_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of moves where one ends and the next begins; every prefix is a chain."""
    moves = relation(spark, sf_dir, "flows").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    return graph.walks(moves, moves.select(F.col("a").alias("id")).distinct(), 2).where(F.size("path") > 1).select(F.array_join("path", ">").alias("chain"), (F.size("path") - 1).alias("steps"))


NEIGHBOURS = ", g AS (SELECT from_id, to_id, status FROM flows WHERE status <> 'rejected'), r AS (SELECT min(from_id) AS id, 0 AS depth FROM g UNION SELECT to_id, depth + 1 FROM r JOIN g ON from_id = id WHERE depth < 2), n AS (SELECT id, CAST(min(depth) AS INT) AS depth FROM r GROUP BY id)"
