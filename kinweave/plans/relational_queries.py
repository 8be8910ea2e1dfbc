"""Filters, joins, aggregates, windows, arrays, visibility and rule queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.functions import numbers
from kinweave.operators import rules
from kinweave.operators.ranking import global_rank
from kinweave.plans.registry import query
from kinweave.shared import table
from kinweave.sources.domain import relation, with_relations


@query("lateral_best_statement", with_relations(""" SELECT c.c_custkey AS person_id, b.claim_id, b.status FROM customer c LEFT JOIN LATERAL
 (SELECT claim_id, status FROM claims JOIN orders ON order_id = o_orderkey WHERE o_custkey = c.c_custkey ORDER BY status, claim_id LIMIT 1) b ON true""", "claims"))
def lateral_best_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first statement of each person, if any: top one on the right, then a left join."""
    made = relation(spark, sf_dir, "claims").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("person_id")), "order_id")
    best = made.groupBy("person_id").agg(F.min(F.struct("status", "claim_id")).alias("b"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id")).join(best, "person_id", "left").select("person_id", "b.claim_id", "b.status")


@query("unpivot_claim_sides", with_relations(""" SELECT side, entity_id, count(*) AS claims FROM (SELECT 'subject' AS side, subject_id AS entity_id FROM claims UNION ALL SELECT 'object', object_id FROM claims) GROUP BY ALL""", "claims"))
def unpivot_claim_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = F.explode(F.array(F.struct(F.lit("subject").alias("side"), F.col("subject_id").alias("entity_id")), F.struct(F.lit("object").alias("side"), F.col("object_id").alias("entity_id"))))
    return relation(spark, sf_dir, "claims").select(sides.alias("s")).groupBy("s.side", "s.entity_id").agg(F.count(F.lit(1)).alias("claims"))


@query("existence_flags", with_relations(""" SELECT person_id, EXISTS (SELECT 1 FROM claims c WHERE c.object_id = person_id AND c.status = 'contested') AS contested, EXISTS (SELECT 1 FROM claims c WHERE c.object_id = person_id AND c.predicate = 'R') AS refuted FROM people""", "people", "claims"))
def existence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = relation(spark, sf_dir, "claims").groupBy(F.col("object_id").alias("person_id")).agg(F.bool_or(F.col("status") == "contested").alias("contested"), F.bool_or(F.col("predicate") == "R").alias("refuted"))
    return relation(spark, sf_dir, "people").select("person_id").join(flags, "person_id", "left").select("person_id", F.coalesce("contested", F.lit(False)).alias("contested"), F.coalesce("refuted", F.lit(False)).alias("refuted"))


@query("either_side_claims", with_relations(""" SELECT claim_id, subject_id, object_id FROM claims WHERE subject_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR object_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""", "claims"))
def either_side_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("id"))
    return rules.either_join(relation(spark, sf_dir, "claims").select("claim_id", "subject_id", "object_id"), ids, ("subject_id", "object_id"), "id")


@query("tree_statistics", with_relations(""" SELECT version_id, count(*) AS edges, count(DISTINCT parent_id) AS parents, count(*) FILTER (WHERE status = 'contested') AS contested, count(DISTINCT CASE WHEN status = 'partial' THEN parent_id END) AS partial_parents, bool_or(status = 'partial') AS any_partial FROM parent_of GROUP BY version_id""", "parent_of"))
def tree_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "parent_of").groupBy("version_id").agg(
        F.count(F.lit(1)).alias("edges"), F.countDistinct("parent_id").alias("parents"), F.count_if(F.col("status") == "contested").alias("contested"),
        F.countDistinct(F.when(F.col("status") == "partial", F.col("parent_id"))).alias("partial_parents"), F.bool_or(F.col("status") == "partial").alias("any_partial"),
    )


@query("decision_rates", """SELECT o_orderpriority AS kind, count(*) FILTER (WHERE o_orderstatus = 'O') AS accepted, count(*) FILTER (WHERE o_orderstatus = 'F') AS corrected, count(*) FILTER (WHERE o_orderstatus = 'P') AS rejected,
 round(count(*) FILTER (WHERE o_orderstatus = 'O') / count(*), 6) AS unchanged_rate, count(*) >= 100 AS measurable FROM orders GROUP BY 1""")
def decision_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(n("O").alias("accepted"), n("F").alias("corrected"), n("P").alias("rejected"), F.round(n("O") / F.count(F.lit(1)), 6).alias("unchanged_rate"), (F.count(F.lit(1)) >= 100).alias("measurable"))


@query("child_histogram", with_relations(""", k AS (SELECT c_custkey AS id, (SELECT count(*) FROM parent_of p WHERE p.parent_id = c_custkey) AS children FROM customer) SELECT children, count(*) AS nodes FROM k GROUP BY children""", "parent_of"))
def child_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all nodes, those without children too."""
    kids = relation(spark, sf_dir, "parent_of").groupBy(F.col("parent_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("k"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(kids, "c_custkey", "left").groupBy(F.coalesce("k", F.lit(0)).alias("children")).agg(F.count(F.lit(1)).alias("nodes"))


@query("dependency_summary", with_relations(""" SELECT from_id, count(*) AS total, count(*) FILTER (WHERE status = 'needs_review') AS needs_review, count(*) FILTER (WHERE status = 'confirmed') AS confirmed, count(*) FILTER (WHERE status = 'rejected') AS rejected FROM flows GROUP BY from_id""", "flows"))
def dependency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["needs_review", "confirmed", "rejected"]
    p = relation(spark, sf_dir, "flows").groupBy("from_id").pivot("status", kinds).count().na.fill(0, kinds)
    return p.withColumn("total", F.col("needs_review") + F.col("confirmed") + F.col("rejected"))


@query("best_claim", with_relations(""" SELECT object_id, arg_min(claim_id, (status, claim_id)) AS claim_id, string_agg(DISTINCT predicate, ',' ORDER BY predicate) AS predicates FROM claims GROUP BY object_id""", "claims"))
def best_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "claims").groupBy("object_id").agg(F.min_by("claim_id", F.struct("status", "claim_id")).alias("claim_id"), F.array_join(F.sort_array(F.collect_set("predicate")), ",").alias("predicates"))


@query("path_json", with_relations(""" SELECT version_id, parent_id, CAST(to_json(list({'p': parent_id, 'c': child_id} ORDER BY child_id)) AS VARCHAR) AS path FROM parent_of GROUP BY version_id, parent_id""", "parent_of"))
def path_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges below each parent as one ordered JSON array."""
    e = relation(spark, sf_dir, "parent_of")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("child_id", "parent_id"))), lambda x: F.struct(x["parent_id"].alias("p"), x["child_id"].alias("c")))
    return e.groupBy("version_id", "parent_id").agg(F.to_json(ordered).alias("path"))


@query("evidence_cap", with_relations(""", r AS (SELECT claim_id, object_id, row_number() OVER (PARTITION BY object_id ORDER BY predicate, subject_id, claim_id) AS n, count(*) OVER (PARTITION BY object_id) AS total FROM claims)
SELECT claim_id, object_id, CAST(n AS INT) AS place, total, total > 5 AS truncated FROM r WHERE n <= 5""", "claims"))
def evidence_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five claims an object; the cap is an output, with its flag."""
    w = Window.partitionBy("object_id")
    r = relation(spark, sf_dir, "claims").select("claim_id", "object_id", F.row_number().over(w.orderBy("predicate", "subject_id", "claim_id")).alias("place"), F.count(F.lit(1)).over(w).alias("total"))
    return r.where("place <= 5").withColumn("truncated", F.col("total") > 5)


@query("latest_revision", """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By aggregation, so a user with most of the rows is no sort."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x"))
    return last.select("user_id", "x.event_id", "x.event_type")


@query("quantiles", """SELECT l_returnflag, round(quantile_cont(l_quantity, 0.25), 6) AS q1, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_quantity, 0.75), 6) AS q3 FROM lineitem GROUP BY 1""")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_quantity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select("l_returnflag", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))])


@query("ranked_medians", """WITH s AS (SELECT p_brand, list_sort(list(p_size)) AS x FROM part GROUP BY p_brand)
SELECT p_brand, x[len(x) // 2 + 1] AS upper_median, CAST(CASE WHEN len(x) % 2 = 1 THEN x[len(x) // 2 + 1] ELSE (x[len(x) // 2] + x[len(x) // 2 + 1]) // 2 END AS INT) AS integer_median, x[CAST(round((len(x) - 1) * 0.95) AS INT) + 1] AS p95 FROM s""")
def ranked_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    half = (F.size(x) / 2).cast("int")
    s = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list("p_size")).alias("x"))
    mid = F.when(F.size(x) % 2 == 1, F.element_at(x, half + 1)).otherwise(((F.get(x, half - 1) + F.element_at(x, half + 1)) / 2).cast("int"))
    return s.select("p_brand", F.element_at(x, half + 1).alias("upper_median"), mid.alias("integer_median"), F.element_at(x, F.round((F.size(x) - 1) * 0.95).cast("int") + 1).alias("p95"))


BUCKET = "CASE WHEN l_discount < 0.02 THEN 0 WHEN l_discount < 0.04 THEN 1 WHEN l_discount < 0.06 THEN 2 WHEN l_discount < 0.08 THEN 3 ELSE 4 END"


@query("calibration_buckets", f"SELECT {BUCKET} AS bucket, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS right, round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 6) AS rate FROM lineitem GROUP BY 1")
def calibration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = F.count_if(F.col("l_returnflag") == "R")
    return table(spark, sf_dir, "lineitem").groupBy(F.expr(BUCKET).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), right.alias("right"), F.round(right / F.count(F.lit(1)), 6).alias("rate"))


@query("metric_histogram", "WITH b AS (SELECT unnest([1.0, 5.0, 10.0, 25.0, 50.0, 100.0]::DOUBLE[]) AS le) SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, b GROUP BY ALL")
def metric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative buckets in one pass: a sum for each bound, then unpivoted."""
    bounds = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0)
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    return sums.select("event_type", F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])).alias("x")).select("event_type", "x.le", "x.n")


@query("dimension_breakdown", """SELECT 'segment' AS dimension, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY c_nationkey""")
def dimension_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass: each row is counted under each of its dimensions."""
    d = F.explode(F.array(F.struct(F.lit("segment").alias("dimension"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("nation").alias("dimension"), F.col("c_nationkey").cast("string").alias("value"))))
    return table(spark, sf_dir, "customer").select(d.alias("d")).groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("n"))


@query("embedding_coverage", "SELECT count(*) AS total, count(vec_id) AS embedded, count(*) - count(vec_id) AS missing FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")).join(table(spark, sf_dir, "embeddings").select("vec_id", F.lit(1).alias("x")), "vec_id", "left")
    return j.agg(F.count(F.lit(1)).alias("total"), F.count("x").alias("embedded"), (F.count(F.lit(1)) - F.count("x")).alias("missing"))


@query("set_operations", """SELECT c_nationkey AS nation, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier UNION SELECT nation, 'customers only' FROM (SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    return c.intersect(s).withColumn("side", F.lit("both")).union(c.exceptAll(s).distinct().join(s, "nation", "left_anti").withColumn("side", F.lit("customers only")))


@query("period_format", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'غير محددة' WHEN o_orderstatus = 'O' THEN 'من ' || year(o_orderdate) WHEN o_custkey % 2 = 0 THEN 'حتى ' || year(o_orderdate) ELSE year(o_orderdate) || ' — ' || (year(o_orderdate) + o_custkey % 60) END AS period FROM orders""")
def period_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate")
    text = F.when(F.col("o_orderstatus") == "P", "غير محددة").when(F.col("o_orderstatus") == "O", F.concat(F.lit("من "), y)).when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("حتى "), y)).otherwise(F.concat(y, F.lit(" — "), y + F.col("o_custkey") % 60))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("period"))


@query("job_claim_order", """SELECT o_orderkey AS job_id, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place, CAST(pow(2, least(o_custkey % 14, 10)) AS BIGINT) AS retry_seconds FROM orders WHERE o_orderstatus = 'P'""")
def job_claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue order and retry delay of waiting jobs."""
    j = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    ranked = global_rank(j.select("o_orderkey", "o_orderpriority", "o_orderdate", "o_custkey"), "o_orderpriority", "o_orderdate", "o_orderkey")
    return ranked.select(F.col("o_orderkey").alias("job_id"), "place", numbers.backoff_seconds(F.col("o_custkey") % 14).cast("long").alias("retry_seconds"))


@query("stale_jobs", """SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY""")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'P'").where(F.col("o_orderdate") < o.agg(F.max("o_orderdate") - F.expr("INTERVAL 365 DAY")).scalar()).select(F.col("o_orderkey").alias("job_id"))


@query("wilson_rates", """WITH r AS (SELECT o_orderpriority AS kind, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS h FROM orders GROUP BY 1),
w AS (SELECT *, (h / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) AS mid, 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) AS half FROM r)
SELECT kind, round(h / n, 6) AS rate, round(greatest(0, mid - half), 6) AS low, round(least(1, mid + half), 6) AS high FROM w""")
def wilson_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("h"))
    low, high = numbers.wilson(F.col("h"), F.col("n"))
    return r.select("kind", F.round(F.col("h") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


EVIDENCE = ", evidence AS (SELECT claim_id, visibility FROM claims JOIN sources ON source_id = 'src' || (order_id % 20))"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = relation(spark, sf_dir, "claims").select("claim_id", F.concat(F.lit("src"), (F.col("order_id") % 20).cast("string")).alias("source_id"))
    return c.join(relation(spark, sf_dir, "sources"), "source_id").select("claim_id", "visibility")


LADDER = "CASE WHEN returnflag = 'A' THEN 'identity_unreviewed' WHEN line > 5 THEN 'claim_unsupported' WHEN linestatus = 'O' AND line > 3 THEN 'evidence_missing' WHEN parent_from > parent_to OR child_from > child_to THEN 'dates_invalid' WHEN child_to < parent_from THEN 'chronology_invalid' ELSE 'qualified' END"
AGES = f", q AS (SELECT *, {LADDER} AS reason FROM intervals), a AS (SELECT edge_id, band, lower, upper, (lower + upper) / 2 AS mid FROM (SELECT edge_id, band, greatest(0.0, (child_from - parent_to) / 365.2425) AS lower, (child_to - parent_from) / 365.2425 AS upper FROM q WHERE reason = 'qualified')), r AS (SELECT band, count(*) AS n, quantile_cont(mid, 0.25) AS q1, quantile_cont(mid, 0.5) AS median, quantile_cont(mid, 0.75) AS q3 FROM a GROUP BY band HAVING count(*) >= 20)"


@query("temporal_qualification", with_relations(f" SELECT {LADDER} AS reason, count(*) AS n FROM intervals GROUP BY 1", "intervals"))
def temporal_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.qualified(relation(spark, sf_dir, "intervals")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower, upper, mid = rules.interval("parent_from", "parent_to", "child_from", "child_to")
    return rules.qualified(relation(spark, sf_dir, "intervals")).where("reason = 'qualified'").select("edge_id", "band", lower.alias("lower"), upper.alias("upper"), mid.alias("mid"))


def bands(a: DataFrame, least: int = 20) -> DataFrame:
    """Quartiles of the middles by group; groups under ``least`` have none."""
    b = a.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.percentile("mid", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).where(F.col("n") >= least)
    return b.select("band", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


@query("temporal_iqr_band", with_relations(AGES + " SELECT band, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3 FROM r", "intervals"))
def temporal_iqr_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands(ages(spark, sf_dir)).select("band", "n", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")])


@query("temporal_findings", with_relations(AGES + " SELECT edge_id, a.band, CASE WHEN upper < q1 THEN 'below' ELSE 'above' END AS finding FROM a JOIN r ON a.band = r.band WHERE upper < q1 OR lower > q3", "intervals"))
def temporal_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ages(spark, sf_dir)
    return a.join(bands(a), "band").where("upper < q1 OR lower > q3").select("edge_id", "band", F.when(F.col("upper") < F.col("q1"), "below").otherwise("above").alias("finding"))
