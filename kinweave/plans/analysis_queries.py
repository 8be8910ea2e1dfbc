"""Entity resolution, places, evidence, trees and evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.functions.numbers import haversine_km
from kinweave.operators import geo, resolution, vectors
from kinweave.operators.components import components
from kinweave.operators.ranking import global_rank
from kinweave.operators.setjoin import similar_by_group
from kinweave.plans.registry import query
from kinweave.plans.text_queries import grams, sets
from kinweave.functions import text as T
from kinweave.shared import table, written
from kinweave.sources.domain import relation, with_relations

BLOCKS = """, k AS (SELECT person_id, 'name' AS kind, name AS key FROM people UNION ALL SELECT person_id, 'tree', CAST(tree_id AS VARCHAR) FROM people UNION ALL SELECT person_id, 'place_decade', concat_ws('/', place, decade, father) FROM people)"""
PAIRS = BLOCKS + """, m AS (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY person_id) AS n FROM k QUALIFY n <= 250),
pr AS (SELECT DISTINCT x.person_id AS a, y.person_id AS b FROM m x JOIN m y USING (kind, key) WHERE x.person_id < y.person_id ORDER BY a, b LIMIT 1000)"""


@query("fuzzy_match_topn", with_relations(f""", n AS (SELECT DISTINCT name, {grams('name')} AS g FROM people), q AS (SELECT x AS query, {grams('x')} AS g FROM unnest(['red wigdet', 'smal ring', 'larg gear']) AS t(x))
SELECT query, name, score, CAST(place AS INT) AS place FROM (SELECT query, name, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, name) AS place FROM (SELECT query, name, round({sets('n.g', 'q.g')}, 6) AS score FROM n JOIN q ON list_has_any(n.g, q.g)) WHERE score >= 0.2) WHERE place <= 3""", "people"))
def fuzzy_match_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals for misspelt names: they meet on shared trigrams."""
    n = relation(spark, sf_dir, "people").select("name").distinct().withColumn("g", T.trigrams(F.col("name")))
    q = spark.createDataFrame([("red wigdet",), ("smal ring",), ("larg gear",)], "query string").withColumn("h", T.trigrams(F.col("query")))
    met = n.select("name", "g", F.explode("g").alias("x")).join(q.select("query", "h", F.explode("h").alias("x")), "x").select("query", "name", "g", "h").distinct()
    s = met.select("query", "name", F.round(T.set_similarity(F.col("g"), F.col("h")), 6).alias("score")).where("score >= 0.2")
    return s.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "name"))).where("place <= 3")


STAYS = ", s AS (SELECT person_id, place_id, min(seen_at) AS since, max(seen_at) AS until, min(lat) AS lat, min(lon) AS lon FROM visits WHERE kind = 'purchase' GROUP BY person_id, place_id)"
KM = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"


@query("haversine_conflicts", with_relations(STAYS + f" SELECT a.person_id, a.place_id AS place_id_a, b.place_id AS place_id_b, round({KM}, 3) AS km FROM s a JOIN s b ON a.person_id = b.person_id AND a.place_id < b.place_id AND a.since <= b.until AND b.since <= a.until WHERE round({KM}, 3) > 15000", "visits"))
def haversine_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = relation(spark, sf_dir, "visits").where("kind = 'purchase'")
    stays = v.groupBy("person_id", "place_id").agg(F.min("seen_at").alias("since"), F.max("seen_at").alias("until"), F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    return geo.conflicts(stays, 15000)


@query("migration_hypotheses", with_relations(", l AS (SELECT person_id, lag(place_id) OVER (PARTITION BY person_id ORDER BY seen_at, visit_id) AS from_place, place_id AS to_place FROM visits WHERE kind = 'signup') SELECT from_place, to_place, count(*) AS moves, count(DISTINCT person_id) AS people FROM l WHERE from_place IS NOT NULL AND from_place <> to_place GROUP BY ALL", "visits"))
def migration_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.moves(relation(spark, sf_dir, "visits").where("kind = 'signup'")).groupBy("from_place", "to_place").agg(F.count(F.lit(1)).alias("moves"), F.countDistinct("person_id").alias("people"))


@query("map_layer_budget", with_relations(", p AS (SELECT kind AS layer, place_id, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM visits WHERE lat BETWEEN -40 AND 60 AND lon BETWEEN -100 AND 100 GROUP BY ALL) SELECT layer, place_id, n, lat, lon FROM p QUALIFY row_number() OVER (PARTITION BY layer ORDER BY n DESC, place_id) <= 10", "visits"))
def map_layer_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inside the viewport, the ten busiest places of each layer."""
    p = relation(spark, sf_dir, "visits").where("lat BETWEEN -40 AND 60 AND lon BETWEEN -100 AND 100").groupBy(F.col("kind").alias("layer"), "place_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))
    return p.withColumn("k", F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("n"), "place_id"))).where("k <= 10").drop("k")


RADIUS = 420.0
PLACES_KM = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"


@query("proximity_clusters", with_relations(f""", p AS (SELECT place_id, min(lat) AS lat, min(lon) AS lon, count(*) AS n FROM visits WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY place_id),
e AS (SELECT a.place_id AS a, b.place_id AS b FROM p a JOIN p b ON a.place_id <> b.place_id AND {PLACES_KM} <= {RADIUS}),
r AS (SELECT place_id AS node, place_id AS reach FROM p UNION SELECT node, b FROM r JOIN e ON reach = a), c AS (SELECT node, min(reach) AS cluster FROM r GROUP BY node),
m AS (SELECT cluster, count(*) AS places, CAST(sum(n) AS BIGINT) AS visits, sum(lat * n) / sum(n) AS lat, sum(lon * n) / sum(n) AS lon FROM c JOIN p ON node = place_id GROUP BY cluster HAVING count(*) >= 2 AND sum(n) >= 2)
SELECT a.cluster, a.places, a.visits, round(a.lat, 6) AS lat, round(a.lon, 6) AS lon, round(max({PLACES_KM}), 3) AS radius_km FROM m a JOIN c ON c.cluster = a.cluster JOIN p b ON b.place_id = c.node GROUP BY ALL""", "visits", recursive=True))
def proximity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within the radius of one another are joined into clusters of two places and two visits at least: centre of all visits, and how far the furthest lies."""
    p = relation(spark, sf_dir, "visits").where("lat IS NOT NULL AND lon IS NOT NULL").groupBy("place_id").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.count(F.lit(1)).alias("n"))
    p = written(p, "places")
    near = geo.within(p, "place_id", RADIUS)
    found = components(near.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    c = p.join(found.select(F.col("node").cast("int").alias("place_id"), F.col("component").cast("int").alias("cluster")), "place_id")
    mid = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("places"), F.sum("n").alias("visits"), (F.sum(F.col("lat") * F.col("n")) / F.sum("n")).alias("mlat"), (F.sum(F.col("lon") * F.col("n")) / F.sum("n")).alias("mlon")).where("places >= 2 AND visits >= 2")
    far = c.join(mid, "cluster").groupBy("cluster", "places", "visits", "mlat", "mlon").agg(F.max(haversine_km(F.col("mlat"), F.col("mlon"), F.col("lat"), F.col("lon"))).alias("r"))
    return far.select("cluster", "places", "visits", F.round("mlat", 6).alias("lat"), F.round("mlon", 6).alias("lon"), F.round("r", 3).alias("radius_km"))


@query("shared_claim_sources", with_relations(", x AS (SELECT DISTINCT order_id % 20 AS source, object_id FROM claims) SELECT a.source AS a, b.source AS b, count(*) AS shared FROM x a JOIN x b ON a.object_id = b.object_id AND a.source < b.source GROUP BY ALL HAVING count(*) >= 2", "claims"))
def shared_claim_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = relation(spark, sf_dir, "claims").select((F.col("order_id") % 20).alias("source"), "object_id").distinct()
    return x.withColumnRenamed("source", "a").join(x.withColumnRenamed("source", "b"), "object_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where("shared >= 2")


@query("near_duplicate_passages", with_relations(f""", g AS (SELECT row_number() OVER (ORDER BY source_id, body) AS k, source_id, {grams('body')} AS g FROM (SELECT DISTINCT source_id, body FROM passages WHERE n_chars >= 80)), n AS (SELECT k, source_id, g, len(g) AS n FROM g)
SELECT a.source_id AS a, b.source_id AS b, count(*) AS pairs FROM n a JOIN n b ON a.source_id < b.source_id AND least(a.n, b.n) >= 0.86 * greatest(a.n, b.n) AND {sets('a.g', 'b.g')} >= 0.86 GROUP BY ALL""", "passages"))
def near_duplicate_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of passages of different sources, 80 characters long at least, whose trigrams agree to 0.86: every such pair."""
    p = relation(spark, sf_dir, "passages").where("n_chars >= 80").select("source_id", "body").distinct()
    return similar_by_group(p.select("source_id", F.array_distinct(T.words(F.col("body"))).alias("w")), "source_id", "w", 0.86, T.trigram_codes)


@query("corroborators", with_relations(" SELECT object_id, count(DISTINCT order_id % 20) AS sources, count(*) FILTER (WHERE status = 'supported') AS support, count(*) FILTER (WHERE status = 'contested') AS counter FROM claims GROUP BY object_id HAVING count(DISTINCT order_id % 20) >= 3", "claims"))
def corroborators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "claims").groupBy("object_id").agg(F.countDistinct(F.col("order_id") % 20).alias("sources"), F.count_if(F.col("status") == "supported").alias("support"), F.count_if(F.col("status") == "contested").alias("counter")).where("sources >= 3")


@query("tree_diff", """WITH a AS (SELECT s_suppkey AS id, s_nationkey AS v FROM supplier WHERE s_acctbal > 0), b AS (SELECT s_suppkey AS id, CASE WHEN s_acctbal > 8000 THEN s_nationkey + 1 ELSE s_nationkey END AS v FROM supplier WHERE s_nationkey <> 7)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.v <> b.v""")
def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a tree, matched by person."""
    s = table(spark, sf_dir, "supplier")
    a = s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("va"))
    b = s.where("s_nationkey <> 7").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 8000, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")).alias("vb"))
    change = F.when(F.col("va").isNull(), "added").when(F.col("vb").isNull(), "removed").when(F.col("va") != F.col("vb"), "changed")
    return a.join(b, "id", "full_outer").select("id", change.alias("change")).where("change IS NOT NULL")


@query("version_copy", with_relations(" SELECT c.edge_id + 1000000 AS edge_id, p.p_partkey + 1000000 AS parent_id, c.child_id + 1000000 AS child_id FROM parent_of c JOIN part p ON p.p_partkey = c.parent_id WHERE c.version_id = 0", "parent_of"))
def version_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a version under new ids, through the map from old to new nodes."""
    new = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("parent_id"), (F.col("p_partkey") + 1000000).alias("new_parent"))
    e = relation(spark, sf_dir, "parent_of").where("version_id = 0").join(new, "parent_id")
    return e.select((F.col("edge_id") + 1000000).alias("edge_id"), F.col("new_parent").alias("parent_id"), (F.col("child_id") + 1000000).alias("child_id"))


@query("activity_feed", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def activity_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type")


RANKED = "WITH r AS (SELECT a.vec_id AS q, b.label = a.label AS hit, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS place FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)"


@query("recall_mrr", RANKED + ", f AS (SELECT q, min(place) FILTER (WHERE hit) AS first FROM r GROUP BY q) SELECT count(*) AS cases, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS success_at_5, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM f")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector is a query against all vectors: blocks of queries meet blocks of vectors as matrices."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"), F.col("label").alias("l"))
    first = vectors.first_hits(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"), asked)
    return first.agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(F.when(F.col("first") <= 5, 1.0).otherwise(0.0)), 6).alias("success_at_5"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


@query("box_overlap", """WITH b AS (SELECT p_partkey AS id, CAST(floor(p_partkey / 80) AS BIGINT) AS page, p_size AS x, p_partkey % 40 AS y, 10 + p_size % 7 AS w, 12 AS h FROM part)
SELECT a, b, round(iou, 6) AS iou FROM (SELECT a.id AS a, b.id AS b, (greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))) AS i, i / (a.w * a.h + b.w * b.h - i) AS iou FROM b a JOIN b ON a.page = b.page AND a.id < b.id) WHERE iou >= 0.5""")
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of one page with half of their union in common."""
    b = boxes(spark, sf_dir)
    # boxes meet on the cells of a grid that they touch; a pair that shares several meets in the one that holds the corner of their overlap
    cell = 16
    steps = lambda at, size: F.explode(F.sequence(F.floor(F.col(at) / cell), F.floor((F.col(at) + F.col(size)) / cell)))
    b = b.select("*", steps("x", "w").alias("cx")).select("*", steps("y", "h").alias("cy"))
    a = b.select("page", "cx", "cy", *[F.col(c).alias(f"{c}a") for c in ("id", "x", "y", "w", "h")])
    first = (F.floor(F.greatest("xa", "x") / cell) == F.col("cx")) & (F.floor(F.greatest("ya", "y") / cell) == F.col("cy"))
    side = lambda p, s: F.greatest(F.lit(0), F.least(F.col(f"{p}a") + F.col(f"{s}a"), F.col(p) + F.col(s)) - F.greatest(f"{p}a", p))
    inter = side("x", "w") * side("y", "h")
    iou = inter / (F.col("wa") * F.col("ha") + F.col("w") * F.col("h") - inter)
    return a.join(b, ["page", "cx", "cy"]).where("ida < id").where(first).where(iou >= 0.5).select(F.col("ida").alias("a"), F.col("id").alias("b"), F.round(iou, 6).alias("iou"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CAST(floor(p_partkey / 80) AS BIGINT) AS page", "p_size AS x", "p_partkey % 40 AS y", "10 + p_size % 7 AS w", "12 AS h", "p_retailprice AS score")


def keep_best(boxes: pd.DataFrame, most: float = 0.5) -> pd.DataFrame:
    """Greedy non-maximum suppression of one page: the best score first, what overlaps it too much goes."""
    rows = boxes.sort_values(["score", "id"], ascending=[False, True])
    kept = []
    for r in rows.itertuples(index=False):
        for k in kept:
            i = max(0, min(r.x + r.w, k.x + k.w) - max(r.x, k.x)) * max(0, min(r.y + r.h, k.y + k.h) - max(r.y, k.y))
            if i / (r.w * r.h + k.w * k.h - i) > most:
                break
        else:
            kept.append(r)
    return pd.DataFrame([(k.page, k.id) for k in kept], columns=["page", "id"])


@query("suppressed_boxes")
def suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is one group; what SQL can't say is the greedy order."""
    return boxes(spark, sf_dir).groupBy("page").applyInPandas(lambda page: keep_best(page), "page long, id long")


@query("tiles", "SELECT s_suppkey AS id, CAST(x AS INT) AS x, CAST(least(x + 100, 300 + s_suppkey % 50) AS INT) AS x_end FROM (SELECT s_suppkey, unnest(range(0, 300 + s_suppkey % 50, 80)) AS x FROM supplier)")
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping tiles of 100 every 80 over each width."""
    width = 300 + F.col("s_suppkey") % 50
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), width.cast("int").alias("w"), F.explode(F.sequence(F.lit(0), width.cast("int") - 1, F.lit(80))).alias("x"))
    return t.select("id", "x", F.least(F.col("x") + 100, F.col("w")).alias("x_end"))


@query("workspace_gaps", with_relations(""" SELECT object_id, CASE WHEN count(*) FILTER (WHERE status = 'supported') = 0 THEN 'no_support' WHEN count(DISTINCT order_id % 20) < 2 THEN 'single_source' WHEN count(*) FILTER (WHERE status = 'contested') > 0 THEN 'contested' ELSE 'none' END AS gap FROM claims GROUP BY object_id""", "claims"))
def workspace_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.when(F.count_if(F.col("status") == "supported") == 0, "no_support").when(F.countDistinct(F.col("order_id") % 20) < 2, "single_source").when(F.count_if(F.col("status") == "contested") > 0, "contested").otherwise("none")
    return relation(spark, sf_dir, "claims").groupBy("object_id").agg(g.alias("gap"))


@query("statement_review_counts", with_relations(" SELECT source_id, count(*) AS passages, count(*) FILTER (WHERE review_status = 'accepted') AS accepted, count(*) FILTER (WHERE review_status = 'rejected') AS rejected, count(*) FILTER (WHERE review_status IS NULL) AS unseen FROM passages LEFT JOIN statements USING (passage_id) GROUP BY source_id", "passages", "statements"))
def statement_review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("review_status")
    return relation(spark, sf_dir, "passages").select("passage_id", "source_id").join(relation(spark, sf_dir, "statements"), "passage_id", "left").groupBy("source_id").agg(F.count(F.lit(1)).alias("passages"), F.count_if(s == "accepted").alias("accepted"), F.count_if(s == "rejected").alias("rejected"), F.count_if(s.isNull()).alias("unseen"))
