"""The archive: people, trees, sources, claims, questions, places and findings over the tables at hand.

Each relation is one projection that both engines read as it stands. Days are whole numbers and years are years, so
that no dialect comes in. Null bounds, dangling references, private rows and draft versions all occur.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from kinweave.shared import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

PLACE = "CAST(substr(props, 7, length(props) - 7) AS INT)"  # props is {"k": number}

RELATIONS = {
    "sources": """SELECT source AS source_id, 'the ' || CASE WHEN k % 2 = 0 THEN 'red' ELSE 'blue' END || ' book ' || k AS title, CASE WHEN k % 7 <> 0 THEN 'author red ' || (k % 6) END AS author, CASE WHEN k % 3 = 0 THEN 'red volume ' || k END AS citation,
        CASE WHEN k % 3 = 0 THEN 'book' ELSE 'chart' END AS source_type, CASE WHEN k % 5 = 0 THEN 'private' ELSE 'public' END AS visibility, k % 3 AS created_by, CASE WHEN k % 7 <> 0 THEN 1900 + k * 3 END AS year_from, CASE WHEN k % 4 <> 0 THEN 1905 + k * 3 END AS year_to, 'independent' AS dependency_status
        FROM (SELECT source, CAST(substr(source, 4) AS INT) AS k FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) AS s) AS s""",
    "passages": "SELECT doc_id AS passage_id, source AS source_id, text AS body, 'p. ' || (doc_id % 90) AS locator, doc_id AS created FROM documents",
    "statements": """SELECT l.doc_id AS statement_id, l.doc_id - l.doc_id % 2 AS passage_id, d.source AS source_id, substr(d.text, 1, 80) AS body, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' ELSE 'needs_review' END AS review_status, l.doc_id % 7 AS created
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id - l.doc_id % 2""",
    "dependencies": "SELECT 'src' || (s_suppkey % 20) AS source_id, 'src' || (s_suppkey * 3 % 20) AS depends_on, CASE s_suppkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'needs_review' ELSE 'rejected' END AS status FROM supplier WHERE s_suppkey % 20 <> s_suppkey * 3 % 20 AND s_suppkey % 3 = 0",
    "people": """SELECT p_partkey AS person_id, p_name AS name, lower(p_name) AS normalized, p_partkey % 50 AS created_by, CASE WHEN p_partkey % 3 = 0 THEN 'confirmed' ELSE 'draft' END AS identity_status, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'female' ELSE 'male' END AS gender,
        CASE WHEN p_partkey % 7 <> 0 THEN p_size * 400 + p_partkey % 300 END AS birth_from, CASE WHEN p_partkey % 11 <> 0 THEN p_size * 400 + p_partkey % 300 + p_partkey % 5 * 200 END AS birth_to,
        CASE WHEN p_partkey % 3 <> 0 THEN p_size * 400 + 9000 + p_partkey % 13 * 1500 END AS death_from, CASE WHEN p_partkey % 3 = 1 THEN p_size * 400 + 9100 + p_partkey % 13 * 1500 END AS death_to FROM part""",
    "aliases": "SELECT p_partkey AS person_id, CASE WHEN p_partkey % 4 = 0 THEN 'red ' || lower(p_type) ELSE lower(p_brand) END AS value, CASE WHEN p_partkey % 6 <> 0 THEN 'src' || (p_partkey % 20) END AS source_id, p_partkey % 10 AS created FROM part WHERE p_partkey % 2 = 0",
    "families": "SELECT s_suppkey AS family_id, 'house ' || lower(s_name) AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'private' ELSE 'public' END AS visibility, CASE WHEN s_suppkey % 3 = 0 THEN 'red widget' END AS alias FROM supplier",
    "tribes": "SELECT n_nationkey AS tribe_id, lower(n_name) AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'private' ELSE 'public' END AS visibility, CASE WHEN n_nationkey % 5 = 0 THEN 'red tribe' END AS alias FROM nation",
    "branches": "SELECT c_custkey AS branch_id, CASE WHEN c_custkey % 9 = 0 THEN 'red ' ELSE '' END || lower(c_mktsegment) AS name, c_custkey % 100 AS family_id, CASE WHEN c_custkey % 6 = 0 THEN 'private' ELSE 'public' END AS visibility FROM customer",
    "places": f"SELECT k AS place_id, CASE WHEN k % 3 = 0 THEN 'red widget town ' ELSE 'place ' END || k AS name, CASE WHEN k % 2 = 0 THEN 'town' ELSE 'region' END AS place_type, CASE WHEN k % 8 = 0 THEN 'private' ELSE 'public' END AS visibility, CASE WHEN k % 13 <> 0 THEN k * 1.2e0 - 60.0e0 END AS lat, CASE WHEN k % 13 <> 0 THEN k * 2.5e0 - 125.0e0 END AS lon FROM (SELECT DISTINCT {PLACE} AS k FROM events) AS e",
    "place_names": f"SELECT k AS place_id, 'old red widget ' || (k % 4) AS name, CASE WHEN k % 2 = 0 THEN 1500 + k END AS year_from, CASE WHEN k % 3 = 0 THEN 1600 + k END AS year_to FROM (SELECT DISTINCT {PLACE} AS k FROM events) AS e WHERE k % 5 = 0",
    "associations": f"""SELECT event_id AS association_id, CASE event_type WHEN 'signup' THEN 'family' WHEN 'error' THEN 'tribe' WHEN 'click' THEN 'branch' ELSE 'person' END AS entity_type, user_id AS entity_id, {PLACE} AS place_id, CASE WHEN event_id % 6 <> 0 THEN 1700 + event_id % 200 END AS year_from, CASE WHEN event_id % 4 <> 0 THEN 1720 + event_id % 200 END AS year_to,
        'src' || (event_id % 20) AS source_id, CASE WHEN event_id % 5 = 0 THEN 'documented' WHEN event_id % 5 = 1 THEN 'interpreted' ELSE 'inferred' END AS status FROM events""",
    "migrations": f"SELECT event_id AS migration_id, user_id AS subject_id, {PLACE} AS from_place, ({PLACE} * 7 + 3) % 100 AS to_place, 1700 + event_id % 200 AS year, 'src' || (event_id % 20) AS source_id FROM events WHERE event_id % 25 = 0",
    "trees": "SELECT t AS tree_id, 'tree red ' || t AS name, CASE WHEN t % 3 = 0 THEN 'private' ELSE 'public' END AS visibility, t % 50 AS owner_id FROM (SELECT DISTINCT CAST(floor(p_partkey / 50) AS BIGINT) AS t FROM part) AS p",
    "versions": "SELECT t * 10 + n AS version_id, t AS tree_id, n AS version_number, CASE WHEN n = 2 OR t % 4 = 0 THEN 'draft' ELSE 'published' END AS state FROM (SELECT DISTINCT CAST(floor(p_partkey / 50) AS BIGINT) AS t FROM part) AS p CROSS JOIN (VALUES (1), (2)) AS v(n)",
    "nodes": "SELECT p_partkey * 10 + n AS node_id, CAST(floor(p_partkey / 50) AS BIGINT) * 10 + n AS version_id, p_partkey AS person_id, p_name AS label FROM part CROSS JOIN (VALUES (1), (2)) AS v(n) WHERE n = 1 OR p_partkey % 2 = 0",
    "collaborators": "SELECT t AS tree_id, t * 3 % 50 AS user_id FROM (SELECT DISTINCT CAST(floor(p_partkey / 50) AS BIGINT) AS t FROM part) AS p WHERE t % 2 = 0",
    "edges": """SELECT p_partkey * 10 + n AS edge_id, CAST(floor(p_partkey / 50) AS BIGINT) * 10 + n AS version_id, p_partkey - p_partkey % 50 + CAST(floor(p_partkey % 50 / (2 + n)) AS BIGINT) AS parent_id, p_partkey AS child_id, CASE p_partkey % 4 WHEN 0 THEN 'spouse_of' ELSE 'parent_of' END AS predicate, CASE WHEN p_partkey % 9 = 0 THEN 'interpreted' WHEN p_partkey % 5 = 0 THEN 'contested' ELSE 'supported' END AS status,
        CASE WHEN p_partkey % 3 <> 0 THEN 'src' || (p_partkey % 20) END AS source_id FROM part CROSS JOIN (VALUES (1), (2)) AS v(n) WHERE p_partkey % 50 > 0 AND (n = 1 OR p_partkey % 10 = 4)""",
    "claims": """SELECT o_orderkey AS claim_id, o_custkey AS subject_id, CAST(floor(o_custkey / 2) AS BIGINT) + o_orderkey % 5 AS object_id, CASE o_orderkey % 5 WHEN 0 THEN 'father_of' WHEN 1 THEN 'parent_of' WHEN 2 THEN 'spouse_of' ELSE 'settled in' END AS predicate, CASE WHEN o_orderkey % 4 = 0 THEN 'a red note ' || o_orderpriority END AS notes,
        CASE o_orderstatus WHEN 'F' THEN 'supported' WHEN 'O' THEN 'contested' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'disputed' ELSE 'rejected' END END AS status, o_custkey % 50 AS created_by, o_orderkey % 100 AS place_id, CASE WHEN o_orderkey % 6 <> 0 THEN 1700 + o_orderkey % 200 END AS year_from, CASE WHEN o_orderkey % 5 <> 0 THEN 1710 + o_orderkey % 200 END AS year_to FROM orders""",
    "evidence": "SELECT l_orderkey AS claim_id, CASE WHEN l_linenumber <= 3 THEN l_partkey - l_partkey % 3 END AS statement_id, CASE WHEN l_linenumber >= 3 THEN l_partkey END AS passage_id, CASE WHEN l_linenumber % 4 = 0 THEN 'refutes' ELSE 'supports' END AS relation FROM lineitem WHERE l_returnflag <> 'N'",
    "counter_evidence": "SELECT l_orderkey AS claim_id, CAST(NULL AS BIGINT) AS statement_id, l_suppkey AS passage_id FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber = 1",
    "questions": """SELECT conv_id * 100 + turn AS question_id, substr(text, 1, 40) AS title, CASE WHEN turn % 4 = 0 THEN substr(text, 41, 80) END AS description, CASE conv_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'investigating' WHEN 2 THEN 'resolved' WHEN 3 THEN 'archived' ELSE 'open' END AS status, CASE conv_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority, conv_id % 10 AS created_by
        FROM conversations WHERE role = 'user'""",
    "question_sources": "SELECT conv_id * 100 + turn AS question_id, 'src' || (conv_id % 20) AS source_id FROM conversations WHERE role = 'user' AND conv_id % 2 = 0",
    "question_claims": "SELECT conv_id * 100 + turn AS question_id, conv_id * 3 + n AS claim_id FROM conversations CROSS JOIN (VALUES (0), (1)) AS v(n) WHERE role = 'user' AND conv_id % 3 <> 0",
    "findings": "SELECT o_orderkey AS finding_id, CASE o_orderkey % 3 WHEN 0 THEN 'contradiction' WHEN 1 THEN 'temporal' ELSE 'spatial' END AS run_kind, CASE WHEN o_orderkey % 3 <> 2 THEN o_orderkey % 70 END AS run_id, lower(o_orderpriority) || ' red finding' AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'two books of red widget differ' ELSE 'dates do not fit' END AS explanation, CASE WHEN o_orderkey % 7 = 0 THEN 'dismissed' ELSE 'open' END AS status FROM orders WHERE o_orderkey % 11 = 0",
}


class Dialect:
    """What the two engines spell differently."""

    def __init__(self, spark: bool):
        self.spark = spark

    def pick(self, here: str, oracle: str) -> str:
        return here if self.spark else oracle

    def words(self, x: str) -> str:
        return self.pick(rf"filter(split(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), w -> w <> '')", rf"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')")

    def ordered_grams(self, x: str) -> str:
        return self.pick(f"flatten(transform({self.words(x)}, w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3))))", f"flatten(list_transform({self.words(x)}, lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))")

    def grams(self, x: str) -> str:
        return f"{self.pick('array_distinct', 'list_distinct')}({self.ordered_grams(x)})"

    def common(self, a: str, b: str) -> str:
        return self.pick(f"size(array_intersect({a}, {b}))", f"len(list_intersect({a}, {b}))")

    def size(self, a: str) -> str:
        return self.pick(f"size({a})", f"len({a})")

    def jaccard(self, a: str, b: str) -> str:
        """Of two arrays without repeats; 0 if both are empty."""
        c = self.common(a, b)
        return f"(CASE WHEN {self.size(a)} + {self.size(b)} > {c} THEN {c} * 1.0e0 / ({self.size(a)} + {self.size(b)} - {c}) ELSE 0.0e0 END)"

    def similarity(self, a: str, b: str) -> str:
        return self.jaccard(self.grams(a), self.grams(b))

    def word_similarity(self, query: str, text: str) -> str:
        """Greatest similarity of the query's trigrams with any run of the text's trigrams in order; a best run begins and ends with a trigram of the query."""
        g, q = self.ordered_grams(text), self.grams(query)
        if self.spark:
            places = f"transform(filter(transform(t.g, (x, i) -> struct(x, i + 1 AS i)), e -> array_contains(t.q, e.x)), e -> e.i)"
            run = "array_distinct(slice(t.g, a, b - a + 1))"
            ratio = f"size(array_intersect({run}, t.q)) * 1.0e0 / size(array_union({run}, t.q))"
            best = f"array_max(flatten(transform({places}, a -> transform(filter({places}, z -> z >= a), b -> {ratio}))))"
            return f"coalesce(transform(array(named_struct('g', {g}, 'q', {q})), t -> {best})[0], 0.0e0)"
        places = "list_filter(range(1, len(t.g) + 1), lambda i: list_contains(t.q, t.g[i]))"
        run = "list_distinct(t.g[a:b])"
        ratio = f"len(list_intersect({run}, t.q)) * 1.0e0 / len(list_distinct(list_concat({run}, t.q)))"
        best = f"list_max(flatten(list_transform({places}, lambda a: list_transform(list_filter({places}, lambda z: z >= a), lambda b: {ratio}))))"
        return f"coalesce(list_transform([{{'g': {g}, 'q': {q}}}], lambda t: {best})[1], 0.0e0)"

    def distinct_list(self, x: str) -> str:
        """Aggregate: sorted array of the distinct values that are not null."""
        return self.pick(f"sort_array(collect_set({x}))", f"coalesce(list_sort(list(DISTINCT {x}) FILTER ({x} IS NOT NULL)), [])")

    def joined(self, a: str, by: str = ",") -> str:
        return self.pick(f"array_join({a}, '{by}')", f"array_to_string({a}, '{by}')")

    def explode(self, a: str) -> str:
        return self.pick(f"explode({a})", f"unnest({a})")

    def array(self, *items: str) -> str:
        return self.pick(f"array({', '.join(items)})", f"[{', '.join(items)}]")

    def haversine(self, lat1: str, lon1: str, lat2: str, lon2: str) -> str:
        return f"2 * 6371.0088e0 * asin(sqrt(least(1.0e0, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"


HERE, ORACLE = Dialect(True), Dialect(False)


def _needed(body: str) -> list[str]:
    return [n for n in RELATIONS if re.search(rf"\b{n}\b", body)]


def statement(body: str) -> str:
    """The body behind the relations it names; a body that begins with a comma brings expressions of its own."""
    parts = ", ".join(f"{n} AS ({RELATIONS[n]})" for n in _needed(body))
    return f"WITH {parts}{body}" if parts else f"WITH {body[2:]}" if body.startswith(", ") else body


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run(spark, sf_dir, f" SELECT * FROM {name}")


def run(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """Plan ``body`` over the archive. Tables are views under names of their own for as long as planning takes."""
    text, own = statement(body), uuid.uuid4().hex[:12]
    tables = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", text)]
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(f"{t}_{own}")
    try:
        return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(tables) or '-'})\b", lambda m: f"{m[1]} {m[2]}_{own}", text))
    finally:
        for t in tables:
            spark.catalog.dropTempView(f"{t}_{own}")
