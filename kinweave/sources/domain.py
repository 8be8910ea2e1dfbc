"""The domain's relations as projections of the tables at hand, said once for Spark and for the oracle SQL.

An expression is one string where both dialects agree, else a pair (Spark, DuckDB).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.shared import table

LATIN = "abcdefghijklmnopqrstuvwxyz"
ARABIC = "اأإآبةتجحدذرزسشصضطظعغفقكىي"

RELATIONS: dict[str, tuple[str, dict[str, str | tuple[str, str]], str]] = {
    "passages": ("documents", {"passage_id": "doc_id", "source_id": "source", "lang": "lang", "body": "text", "n_chars": "n_chars"}, "true"),
    "statements": ("labels", {"statement_id": "doc_id", "passage_id": "doc_id", "review_status": "CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' ELSE 'unreviewed' END"}, "true"),
    "sources": ("(SELECT DISTINCT source FROM documents)", {"source_id": "source", "visibility": "CASE WHEN CAST(substr(source, 4) AS INT) % 5 = 0 THEN 'private' ELSE 'public' END", "owner_id": "CAST(substr(source, 4) AS INT) % 3"}, "true"),
    "people": ("part", {"person_id": "p_partkey", "name": "p_name", "father": "p_brand", "place": "p_type", "decade": "CAST(floor(p_size / 10) AS INT)", "birth_from": "1900 + p_size", "birth_to": "1900 + p_size + p_partkey % 4", "tree_id": "p_partkey % 40", "owner_id": "p_partkey % 50", "tree_visibility": "CASE WHEN p_partkey % 40 % 3 = 0 THEN 'private' ELSE 'public' END", "name_ar": f"translate(lower(p_name), '{LATIN}', '{ARABIC}')"}, "true"),
    "parent_of": ("customer", {"edge_id": "c_custkey", "parent_id": "CAST(floor(c_custkey / 3) AS BIGINT)", "child_id": "c_custkey", "version_id": "c_custkey % 2", "status": "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'contested' WHEN c_mktsegment = 'BUILDING' THEN 'partial' ELSE 'supported' END"}, "c_custkey > 0"),
    "flows": ("(SELECT s_nationkey AS f, c_nationkey AS t, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, c_nationkey)", {"from_id": "f", "to_id": "t", "n": "n", "status": "CASE WHEN (f + t) % 4 = 0 THEN 'rejected' WHEN (f + t) % 4 = 1 THEN 'needs_review' ELSE 'confirmed' END"}, "f <> t"),
    "questions": ("conversations", {"conv_id": "conv_id", "turn": "turn", "owner_id": "conv_id % 10", "body": "text"}, "role = 'user'"),
    "claims": ("lineitem", {"claim_id": "l_orderkey * 10 + l_linenumber", "subject_id": "l_suppkey", "object_id": "l_partkey", "predicate": "l_returnflag", "status": "CASE WHEN l_linestatus = 'F' THEN 'supported' WHEN l_linenumber > 5 THEN 'contested' ELSE 'disputed' END", "order_id": "l_orderkey", "claimed_at": ("to_date(l_shipdate)", "CAST(l_shipdate AS DATE)"), "line": "l_linenumber"}, "true"),
    "visits": ("events", {"visit_id": "event_id", "person_id": "user_id", "place_id": ("CAST(get_json_object(props, '$.k') AS INT)", "CAST(props->>'k' AS INT)"), "kind": "event_type", "seen_at": "ts", "lat": ("CAST(get_json_object(props, '$.k') AS INT) * 1.7D - 85.0D", "CAST(props->>'k' AS INT) * 1.7::DOUBLE - 85.0::DOUBLE"), "lon": ("CAST(get_json_object(props, '$.k') AS INT) * 3.5D - 175.0D", "CAST(props->>'k' AS INT) * 3.5::DOUBLE - 175.0::DOUBLE")}, "true"),
    "intervals": ("(SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)", {"edge_id": "l_orderkey * 10 + l_linenumber", "parent_id": "o_custkey", "child_id": "l_partkey", "parent_from": ("date_sub(to_date(o_orderdate), l_linenumber)", "CAST(o_orderdate AS DATE) - l_linenumber"), "parent_to": ("date_add(to_date(o_orderdate), l_linenumber)", "CAST(o_orderdate AS DATE) + l_linenumber"), "child_from": ("date_sub(to_date(l_shipdate), l_linenumber)", "CAST(l_shipdate AS DATE) - l_linenumber"), "child_to": ("date_add(to_date(l_shipdate), l_linenumber)", "CAST(l_shipdate AS DATE) + l_linenumber"), "band": "o_orderpriority", "linestatus": "l_linestatus", "returnflag": "l_returnflag", "line": "l_linenumber"}, "true"),
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain relation as a lazy projection; filters and columns still reach the scan."""
    source, columns, where = RELATIONS[name]
    exprs = [f"{e if isinstance(e, str) else e[0]} AS {c}" for c, e in columns.items()]
    if source.isidentifier():
        return table(spark, sf_dir, source).where(where).selectExpr(*exprs)
    t = lambda n: table(spark, sf_dir, n)
    if name == "sources":
        df = t("documents").select("source").distinct()
    elif name == "flows":
        joined = t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey").join(t("orders"), "o_orderkey")
        joined = joined.withColumnRenamed("o_custkey", "c_custkey").join(t("customer"), "c_custkey").withColumnRenamed("l_suppkey", "s_suppkey").join(t("supplier"), "s_suppkey")
        df = joined.groupBy("s_nationkey", "c_nationkey").count().selectExpr("s_nationkey AS f", "c_nationkey AS t", "count AS n")
    else:
        df = t("lineitem").join(t("orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    return df.where(where).selectExpr(*exprs)


def with_relations(body: str, *names: str, recursive: bool = False) -> str:
    """Oracle SQL with these relations as common table expressions before ``body`` (which may start with more of them and a comma)."""
    parts = []
    for name in names:
        source, columns, where = RELATIONS[name]
        exprs = ", ".join(f"{e if isinstance(e, str) else e[1]} AS {c}" for c, e in columns.items())
        parts.append(f"{name} AS (SELECT {exprs} FROM {source} WHERE {where})")
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)}{body}"
