"""Entity resolution, graph, text, hash and evaluation queries over the archive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import hashes, numbers
from kinweave.functions import text as T
from kinweave.operators import evaluation, graph, matching, resolution
from kinweave.operators.components import components
from kinweave.operators.ranking import global_rank
from kinweave.plans.registry import archived, query
from kinweave.shared import table
from kinweave.sources.archive import Dialect, ORACLE, run, statement

#: Facts about people: each a select of person_id and value. Parents come from claims (the subject of father_of is the child) and published edges.
PARENTS = "(SELECT subject_id AS child, object_id AS parent FROM claims WHERE predicate = 'father_of' AND status = 'supported' UNION SELECT object_id, subject_id FROM claims WHERE predicate = 'parent_of' AND status = 'supported' UNION SELECT e.child_id, e.parent_id FROM edges e JOIN versions v ON v.version_id = e.version_id WHERE v.state = 'published' AND e.predicate = 'parent_of')"
FACTS = {
    "aliases": "SELECT person_id, value FROM aliases",
    "fathers": f"SELECT child AS person_id, parent AS value FROM {PARENTS} AS p",
    "grandfathers": f"SELECT p.child AS person_id, g.parent AS value FROM {PARENTS} AS p JOIN {PARENTS} AS g ON g.child = p.parent",
    "children": f"SELECT parent AS person_id, child AS value FROM {PARENTS} AS p",
    "siblings": f"SELECT p.child AS person_id, s.child AS value FROM {PARENTS} AS p JOIN {PARENTS} AS s ON s.parent = p.parent AND s.child <> p.child WHERE p.parent % 7 = 0 OR p.parent % 7 <> 0",
    "spouses": "SELECT parent_id AS person_id, child_id AS value FROM edges WHERE predicate = 'spouse_of' UNION SELECT child_id, parent_id FROM edges WHERE predicate = 'spouse_of'",
    "places": "SELECT entity_id AS person_id, place_id AS value FROM associations WHERE entity_type = 'person'",
    "sources": "SELECT a.entity_id AS person_id, a.source_id AS value FROM associations a WHERE entity_type = 'person' AND status <> 'inferred'",
    "trees": "SELECT n.person_id, v.tree_id AS value FROM nodes n JOIN versions v ON v.version_id = n.version_id",
    "branches": "SELECT b.branch_id AS person_id, b.family_id AS value FROM branches b WHERE b.branch_id % 3 = 0",
}
NAMED = "SELECT person_id, normalized, gender, birth_from, birth_to, death_from, death_to FROM people"


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.snapshot(run(spark, sf_dir, f" {NAMED}"), **{k: run(spark, sf_dir, f" {v}") for k, v in FACTS.items()})


def snapshot_sql() -> str:
    lists = ", ".join(f"f_{k} AS (SELECT person_id, list_sort(list(DISTINCT CAST(value AS VARCHAR))) AS {k} FROM ({v}) AS x WHERE value IS NOT NULL GROUP BY person_id)" for k, v in FACTS.items())
    picked = ", ".join(f"coalesce(f_{k}.{k}, []) AS {k}" for k in FACTS)
    joins = " ".join(f"LEFT JOIN f_{k} ON f_{k}.person_id = p.person_id" for k in FACTS)
    return f", {lists}, snap AS MATERIALIZED (SELECT p.*, {picked} FROM ({NAMED}) AS p {joins})"


def blocks_sql() -> str:
    each = " UNION ALL ".join(f"SELECT person_id, '{kind}', trim(x) FROM (SELECT person_id, unnest({c}) AS x FROM snap) AS u" for kind, c in (("alias", "aliases"), ("father", "fathers"), ("grandfather", "grandfathers"), ("place", "places"), ("tree", "trees"), ("branch", "branches")))
    year = lambda x, y: f"CAST(floor(coalesce({x}, {y}) / 365) AS BIGINT)"
    spans = " UNION ALL ".join(f"SELECT person_id, '{k}' AS kind, CAST(floor(least({year(f'{k}_from', f'{k}_to')}, {year(f'{k}_to', f'{k}_from')}) / 10) * 10 AS BIGINT) AS lo, CAST(floor(greatest({year(f'{k}_from', f'{k}_to')}, {year(f'{k}_to', f'{k}_from')}) / 10) * 10 AS BIGINT) AS hi FROM snap WHERE {k}_from IS NOT NULL OR {k}_to IS NOT NULL" for k in ("birth", "death"))
    return f""", blk AS (SELECT DISTINCT person_id, kind, key FROM (SELECT person_id, 'name' AS kind, trim(normalized) AS key FROM snap UNION ALL {each}
      UNION ALL SELECT person_id, 'date', kind || ':' || y FROM (SELECT person_id, kind, unnest(range(lo, least(hi, lo + 30) + 1, 10)) AS y FROM ({spans}) AS s) AS t) AS k WHERE key <> '')"""


PAIRS_SQL = f""", m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY person_id) AS n FROM blk) WHERE n <= {resolution.PER_BLOCK}),
pr AS (SELECT a, b FROM (SELECT DISTINCT x.person_id AS a, y.person_id AS b FROM m x JOIN m y USING (kind, key) WHERE x.person_id < y.person_id) ORDER BY a || '|' || b LIMIT {resolution.MOST_PAIRS})"""


@query("er_snapshot", statement(snapshot_sql() + " SELECT person_id, normalized, gender, " + ", ".join(f"array_to_string({k}, ',') AS {k}" for k in FACTS) + " FROM snap"))
def er_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person in one row: names, kin by five relations, places, accepted sources, trees and branches."""
    return snapshot(spark, sf_dir).select("person_id", "normalized", "gender", *[F.array_join(k, ",").alias(k) for k in FACTS])


@query("er_blocks", statement(snapshot_sql() + blocks_sql() + " SELECT kind, key, count(*) AS members FROM blk GROUP BY kind, key"))
def er_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.blocks(snapshot(spark, sf_dir)).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("members"))


@query("er_pairs_capped", statement(snapshot_sql() + blocks_sql() + PAIRS_SQL + " SELECT a, b FROM pr"))
def er_pairs_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.pairs(resolution.blocks(snapshot(spark, sf_dir)))


def score_sql() -> str:
    d = ORACLE
    edit = "CASE WHEN u = '' OR v = '' THEN 0.0 WHEN u = v THEN 1.0 ELSE greatest(1 - levenshtein(u, v) / greatest(len(u), len(v)), " + d.jaccard("list_distinct(string_split(u, ' '))", "list_distinct(string_split(v, ' '))") + ") END"
    name = f"list_max(flatten(list_transform(list_concat([x.normalized], x.aliases), lambda u: list_transform(list_concat([y.normalized], y.aliases), lambda v: {edit}))))"
    both = {k: f"(len(x.{k}) > 0 AND len(y.{k}) > 0)" for k in (*resolution.RELATIONS, "places", "sources")}
    mean = lambda parts, weights: "(" + " + ".join(f"coalesce({weights[k]} * {x}, 0.0)" for k, x in parts.items()) + ") / nullif(" + " + ".join(f"CASE WHEN {x} IS NOT NULL THEN {weights[k]} ELSE 0.0 END" for k, x in parts.items()) + ", 0)"
    rel = mean({k: f"(CASE WHEN {both[k]} THEN {d.jaccard(f'x.{k}', f'y.{k}')} END)" for k in resolution.RELATIONS}, {k: f"{w}::DOUBLE" for k, w in resolution.RELATIONS.items()})
    disjoint = " OR ".join(f"({both[k]} AND NOT list_has_any(x.{k}, y.{k}))" for k in resolution.RELATIONS)
    weights = {k: f"{w}::DOUBLE" for k, w in resolution.WEIGHTS.items()}
    final = mean({k: k for k in resolution.WEIGHTS}, weights)
    return f""", base AS (SELECT pr.a, pr.b, {name} AS name, CASE WHEN ex.embedding IS NOT NULL AND ey.embedding IS NOT NULL THEN greatest(0.0, least(1.0, list_cosine_similarity(ex.embedding::DOUBLE[], ey.embedding::DOUBLE[]))) END AS embedding, {rel} AS relationship, CASE WHEN {both['places']} THEN {d.jaccard('x.places', 'y.places')} END AS geography, CASE WHEN {both['sources']} THEN {d.jaccard('x.sources', 'y.sources')} END AS source_context,
      {disjoint} AS disjoint, x.gender <> '' AND y.gender <> '' AND x.gender <> y.gender AS genders,
      coalesce(x.birth_from, x.birth_to) IS NOT NULL AND coalesce(y.birth_from, y.birth_to) IS NOT NULL AS born, coalesce(x.birth_from, x.birth_to) AS xb, coalesce(x.birth_to, x.birth_from) AS xe, coalesce(y.birth_from, y.birth_to) AS yb, coalesce(y.birth_to, y.birth_from) AS ye,
      coalesce(x.death_from, x.death_to) AS xdb, coalesce(x.death_to, x.death_from) AS xde, coalesce(y.death_from, y.death_to) AS ydb, coalesce(y.death_to, y.death_from) AS yde
      FROM pr JOIN snap x ON x.person_id = pr.a JOIN snap y ON y.person_id = pr.b LEFT JOIN embeddings ex ON ex.vec_id = pr.a LEFT JOIN embeddings ey ON ey.vec_id = pr.b),
    t AS (SELECT *, CASE WHEN born THEN greatest(yb - xe, xb - ye) WHEN xdb IS NOT NULL AND ydb IS NOT NULL THEN greatest(ydb - xde, xdb - yde) END AS gap FROM base),
    u AS (SELECT *, CASE WHEN gap <= 0 THEN 1.0::DOUBLE WHEN gap > 0 THEN greatest(0.0, 1 - gap / 365 / 80) END AS chronology, disjoint OR coalesce(gap > 0, false) OR genders AS conflict FROM t),
    r AS (SELECT *, {final} AS raw FROM u), f AS (SELECT *, round(CASE WHEN conflict AND raw >= 0.78 THEN 0.49 ELSE raw END, 6) AS score FROM r)
    SELECT a, b, {', '.join(f'round({k}, 6) AS {k}' for k in resolution.WEIGHTS)}, score, CASE WHEN score >= 0.75 THEN 'strong' WHEN score >= 0.55 THEN 'possible' ELSE 'likely_different' END AS class, conflict FROM f"""


@query("er_scores_classified", statement(snapshot_sql() + blocks_sql() + PAIRS_SQL + score_sql()))
def er_scores_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six scores, shared out over those that are there; hard conflicts hold the total down."""
    snap = snapshot(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("person_id"), "embedding")
    return resolution.scored(resolution.pairs(resolution.blocks(snap)), snap, vectors)


@archived
def single_name_resolve(d: Dialect) -> str:
    """One name against all: 1 for the name itself, .95 for an alias, else the share of its words."""
    q, words = "'red ring'", d.pick("array_distinct", "list_distinct")
    share = f"{d.common(f'{words}({d.words(q)})', f'{words}({d.words("p.normalized")})')} * 1.0e0 / greatest(1, {d.size(f'{words}({d.words(q)})')})"
    return f""", s AS (SELECT p.person_id, CASE WHEN p.normalized = {q} THEN 'canonical' WHEN a.person_id IS NOT NULL THEN 'alias' WHEN {share} > 0 THEN 'token_overlap' ELSE 'none' END AS matched_on, round(CASE WHEN p.normalized = {q} THEN 1.0e0 WHEN a.person_id IS NOT NULL THEN 0.95e0 ELSE {share} END, 4) AS score
      FROM people p LEFT JOIN (SELECT DISTINCT person_id FROM aliases WHERE value = {q}) AS a ON a.person_id = p.person_id)
    SELECT person_id, matched_on, score FROM s ORDER BY score DESC, person_id LIMIT 20"""


@archived
def import_fuzzy_match(d: Dialect) -> str:
    """Proposals for imported names: the name itself, else an alias, else trigrams above the floor; three a name, and never a decision."""
    sim = d.similarity("q.query", "p.normalized")
    return f""", q AS (SELECT * FROM (VALUES ('red ring'), ('red economy'), ('smal rign'), ('xyz')) AS v(query)),
    c AS (SELECT q.query, p.person_id, CASE WHEN p.normalized = q.query THEN 'exact' WHEN a.person_id IS NOT NULL THEN 'alias' ELSE 'trigram' END AS how, round(CASE WHEN p.normalized = q.query THEN 1.0e0 WHEN a.person_id IS NOT NULL THEN 0.95e0 ELSE {sim} END, 6) AS score
      FROM q CROSS JOIN people p LEFT JOIN (SELECT DISTINCT person_id, value FROM aliases) AS a ON a.person_id = p.person_id AND a.value = q.query)
    SELECT query, person_id, how, score, CAST(n AS INT) AS place FROM (SELECT c.*, row_number() OVER (PARTITION BY query ORDER BY CASE how WHEN 'exact' THEN 0 WHEN 'alias' THEN 1 ELSE 2 END, score DESC, person_id) AS n FROM c WHERE how <> 'trigram' OR score >= 0.3e0) AS x WHERE n <= 3"""


# graph


def kin_steps(spark: SparkSession, sf_dir: str, up: bool = True) -> DataFrame:
    e = run(spark, sf_dir, " SELECT e.edge_id, e.parent_id, e.child_id, e.status FROM edges e JOIN versions v ON v.version_id = e.version_id WHERE v.version_number = 1 AND e.predicate = 'parent_of'")
    a, b = ("child_id", "parent_id") if up else ("parent_id", "child_id")
    return e.select("edge_id", "status", F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))


KIN_SQL = "kin AS (SELECT e.edge_id, e.status, e.child_id AS a, e.parent_id AS b FROM edges e JOIN versions v ON v.version_id = e.version_id WHERE v.version_number = 1 AND e.predicate = 'parent_of')"


def recursive(body: str) -> str:
    return statement(body).replace("WITH ", "WITH RECURSIVE ", 1)


@query("ancestor_frontier_report", recursive(f""", {KIN_SQL}, r AS (SELECT CAST(147 AS BIGINT) AS id, 0 AS depth UNION SELECT kin.b, r.depth + 1 FROM r JOIN kin ON kin.a = r.id WHERE r.depth < 4), n AS (SELECT id, CAST(min(depth) AS INT) AS depth FROM r GROUP BY id),
inner_edges AS (SELECT kin.*, x.depth AS da, y.depth AS db FROM kin JOIN n x ON x.id = kin.a JOIN n y ON y.id = kin.b)
SELECT n.depth, count(DISTINCT n.id) AS nodes, (SELECT count(*) FILTER (WHERE status = 'contested') FROM inner_edges) AS contested, (SELECT coalesce(bool_or(db <= da), false) FROM inner_edges) AS cycle_detected FROM n GROUP BY n.depth"""))
def ancestor_frontier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors by depth, edge status counts, and whether an edge leads back into what was visited (which a way that joins again does too)."""
    steps = kin_steps(spark, sf_dir)
    nodes = graph.bounded_bfs(steps.select("a", "b"), spark.createDataFrame([(147,)], "id long"), 4)
    ends = lambda s: nodes.select(F.col("id").alias(s), F.col("depth").alias(f"d{s}"))
    inner = steps.join(F.broadcast(ends("a")), "a").join(F.broadcast(ends("b")), "b")
    facts = inner.agg(F.count_if(F.col("status") == "contested").alias("contested"), F.coalesce(F.bool_or(F.col("db") <= F.col("da")), F.lit(False)).alias("cycle_detected"))
    return nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("nodes")).crossJoin(F.broadcast(facts))


@query("lineage_focus", recursive(f""", {KIN_SQL}, und AS (SELECT a, b FROM kin UNION SELECT b, a FROM kin), r AS (SELECT CAST(110 AS BIGINT) AS id, 0 AS depth UNION SELECT und.b, r.depth + 1 FROM r JOIN und ON und.a = r.id WHERE r.depth < 2), n AS (SELECT id, CAST(min(depth) AS INT) AS depth FROM r GROUP BY id)
SELECT id, depth, count(*) OVER () > 200 AS truncated FROM n"""))
def lineage_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whoever is within two steps of a person, either way."""
    steps = graph.undirected(kin_steps(spark, sf_dir), "a", "b")
    return graph.bounded_bfs(steps, spark.createDataFrame([(110,)], "id long"), 2)


@query("common_ancestor_paths", recursive(f""", {KIN_SQL}, x AS (SELECT [CAST(133 AS BIGINT)] AS path UNION ALL SELECT list_append(path, kin.b) FROM x JOIN kin ON kin.a = path[-1] WHERE len(path) <= 3 AND NOT list_contains(path, kin.b)), y AS (SELECT [CAST(146 AS BIGINT)] AS path UNION ALL SELECT list_append(path, kin.b) FROM y JOIN kin ON kin.a = path[-1] WHERE len(path) <= 3 AND NOT list_contains(path, kin.b)),
met AS (SELECT x.path[-1] AS ancestor, len(x.path) + len(y.path) - 2 AS hops, array_to_string(list_concat(x.path, list_reverse(y.path[1:len(y.path) - 1])), '>') AS path FROM x JOIN y ON x.path[-1] = y.path[-1] WHERE len(x.path) + len(y.path) - 2 <= 6)
SELECT ancestor, CAST(hops AS INT) AS hops, path FROM (SELECT *, row_number() OVER (PARTITION BY ancestor ORDER BY hops, path) AS n FROM met) WHERE n = 1 ORDER BY hops, ancestor LIMIT 5"""))
def common_ancestor_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways up from both people that meet: of each ancestor the shortest, walked up on one side and, turned around, down the other."""
    steps = kin_steps(spark, sf_dir).select("a", "b")
    up = lambda i, s: graph.walks(steps, spark.createDataFrame([(i,)], "id long"), 3).select(F.element_at("path", -1).alias("ancestor"), F.col("path").alias(s))
    met = up(133, "x").join(up(146, "y"), "ancestor").withColumn("hops", F.size("x") + F.size("y") - 2).where("hops <= 6")
    way = F.array_join(F.concat("x", F.reverse(F.slice("y", 1, F.size("y") - 1))), ">")
    best = met.groupBy("ancestor").agg(F.min(F.struct("hops", way.alias("path"))).alias("m"))
    return best.select("ancestor", "m.hops", "m.path").orderBy("hops", "ancestor").limit(5)


@query("path_edges", recursive(f""", {KIN_SQL}, p AS (SELECT [CAST(147 AS BIGINT)] AS path UNION ALL SELECT list_append(path, kin.b) FROM p JOIN kin ON kin.a = path[-1] WHERE len(path) <= 3 AND NOT list_contains(path, kin.b))
SELECT array_to_string(path, '>') AS path, CAST(i AS INT) AS nth, path[i] AS from_id, path[i + 1] AS to_id FROM (SELECT path, unnest(range(1, len(path))) AS i FROM p)"""))
def path_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as their edges, numbered from the start."""
    found = graph.walks(kin_steps(spark, sf_dir).select("a", "b"), spark.createDataFrame([(147,)], "id long"), 3)
    return found.select("path", F.posexplode(F.slice("path", 2, F.size("path"))).alias("i", "to_id")).select(F.array_join("path", ">").alias("path"), (F.col("i") + 1).alias("nth"), F.get("path", F.col("i")).alias("from_id"), "to_id")


ACTIVE = "act AS (SELECT source_id AS a, depends_on AS b, status FROM dependencies WHERE status <> 'rejected' AND source_id IN (SELECT source_id FROM sources WHERE visibility = 'public') AND depends_on IN (SELECT source_id FROM sources WHERE visibility = 'public'))"


def dependency_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, f", {ACTIVE} SELECT a, b, status FROM act")


@query("dependency_neighborhood", recursive(f""", {ACTIVE}, r AS (SELECT 'src9' AS id, 0 AS depth UNION SELECT act.b, r.depth + 1 FROM r JOIN act ON act.a = r.id WHERE r.depth < 4), n AS (SELECT id, CAST(min(depth) AS INT) AS depth FROM r GROUP BY id) SELECT id, depth, false AS truncated FROM n"""))
def dependency_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed, over active dependencies of public sources, with one budget of nodes for all levels."""
    return graph.bounded_bfs(dependency_steps(spark, sf_dir).select("a", "b").distinct(), spark.createDataFrame([("src9",)], "id string"), 4, budget=True)


@query("dependency_communities")
def dependency_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities among the sources around a root: at most 200 nodes, in one task, since each merge hangs on the last."""
    steps = dependency_steps(spark, sf_dir)
    nodes = dependency_neighborhood(spark, sf_dir)
    inner = graph.inner_edges(steps.select("a", "b"), nodes, "a", "b").select(F.lit("src9").alias("root"), "a", "b")
    return inner.groupBy("root").applyInPandas(lambda g: graph.modularity_communities(g), "community string, node string, size long")


TIES = "ties AS (SELECT CAST(floor(c_custkey / 30) AS BIGINT) AS version_id, c_custkey AS a, c_custkey - c_custkey % 30 + (c_custkey % 30 * 7 + 3) % 30 AS b FROM customer WHERE c_custkey % 11 <> 0)"


@query("relationship_loops", f"""WITH RECURSIVE {TIES}, r AS (SELECT version_id, a AS root, [a] AS path, b AS nxt FROM ties UNION ALL SELECT r.version_id, root, list_append(path, nxt), ties.b FROM r JOIN ties ON ties.version_id = r.version_id AND ties.a = r.nxt WHERE nxt <> root AND NOT list_contains(path, nxt) AND len(path) < 40)
SELECT DISTINCT version_id, array_to_string(list_sort(path), ',') AS loop, CAST(len(path) AS INT) AS length FROM r WHERE nxt = root AND len(path) > 1""")
def relationship_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops of any length in the relationships of a version, whatever they say, each as its sorted people. Only the part of a version that can hold a loop is walked."""
    ties = table(spark, sf_dir, "customer").where("c_custkey % 11 <> 0").selectExpr("CAST(floor(c_custkey / 30) AS BIGINT) AS version_id", "c_custkey AS a", "c_custkey - c_custkey % 30 + (c_custkey % 30 * 7 + 3) % 30 AS b")

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        found = graph.loops(g)
        return pd.DataFrame({"version_id": [g["version_id"].iloc[0]] * len(found), "loop": [",".join(map(str, x)) for x in found], "length": [len(x) for x in found]})

    return graph.cyclic_core(ties, "version_id").groupBy("version_id").applyInPandas(walk, "version_id long, loop string, length int")


@query("draft_cycle_check", f"""WITH RECURSIVE {TIES}, r AS (SELECT version_id, a AS root, b AS reached FROM ties UNION SELECT r.version_id, root, ties.b FROM r JOIN ties ON ties.version_id = r.version_id AND ties.a = r.reached)
SELECT t.version_id, count(*) AS edges, count(*) FILTER (WHERE c.root IS NOT NULL) AS edges_on_cycles FROM ties t LEFT JOIN (SELECT DISTINCT version_id, root FROM r WHERE reached = root) c ON c.version_id = t.version_id AND c.root = t.a GROUP BY t.version_id""")
def draft_cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether staged edges close a cycle, by draft: what is left when ends are taken off again and again."""
    ties = table(spark, sf_dir, "customer").where("c_custkey % 11 <> 0").selectExpr("CAST(floor(c_custkey / 30) AS BIGINT) AS version_id", "c_custkey AS a", "c_custkey - c_custkey % 30 + (c_custkey % 30 * 7 + 3) % 30 AS b")
    core = graph.cyclic_core(ties, "version_id").groupBy("version_id").agg(F.count(F.lit(1)).alias("on"))
    return ties.groupBy("version_id").agg(F.count(F.lit(1)).alias("edges")).join(core, "version_id", "left").select("version_id", "edges", F.coalesce("on", F.lit(0)).cast("long").alias("edges_on_cycles"))


OCCURRENCES = "occ AS (SELECT o_orderkey AS a, o_orderkey - o_orderkey % 40 + (o_orderkey * 3) % 40 AS b FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0)"


@query("occurrence_lineage", f"""WITH RECURSIVE {OCCURRENCES}, und AS (SELECT a, b FROM occ UNION SELECT b, a FROM occ), r AS (SELECT a AS node, a AS reach FROM und UNION SELECT node, und.b FROM r JOIN und ON und.a = reach)
SELECT node, lineage FROM (SELECT node, min(reach) AS lineage FROM r GROUP BY node) WHERE node IN (SELECT a FROM occ WHERE a <> b UNION SELECT b FROM occ WHERE a <> b)""")
def occurrence_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of one name that lead to one another, either way and over any number of steps."""
    occ = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_orderkey % 2 = 0").selectExpr("o_orderkey AS a", "o_orderkey - o_orderkey % 40 + (o_orderkey * 3) % 40 AS b")
    return components(occ).select("node", F.col("component").alias("lineage"))


@archived
def evidence_connection(d: Dialect) -> str:
    """Ways between people over one, two or three visible, supported claims, none twice: how many lead where, and the first."""
    return f""", c AS (SELECT claim_id, subject_id AS x, object_id AS y FROM claims WHERE status = 'supported' AND claim_id IN (SELECT claim_id FROM evidence) UNION ALL SELECT claim_id, object_id, subject_id FROM claims WHERE status = 'supported' AND claim_id IN (SELECT claim_id FROM evidence)),
    one AS (SELECT x AS start, y AS far, claim_id AS c1 FROM c WHERE x = 20), two AS (SELECT o.start, c.y AS far, o.c1, c.claim_id AS c2 FROM one o JOIN c ON c.x = o.far WHERE c.claim_id <> o.c1), three AS (SELECT t.start, c.y AS far, t.c1, t.c2, c.claim_id AS c3 FROM two t JOIN c ON c.x = t.far WHERE c.claim_id <> t.c1 AND c.claim_id <> t.c2)
    SELECT far AS target, hops, count(*) AS paths, min(c1) AS first_claim FROM (SELECT far, 1 AS hops, c1 FROM one UNION ALL SELECT far, 2, c1 FROM two UNION ALL SELECT far, 3, c1 FROM three) AS w WHERE far <> 20 GROUP BY far, hops"""


@archived
def branch_claims(d: Dialect) -> str:
    """Claims around a person by id, fifty pieces of evidence each at most, in order of relation and reference."""
    return """, star AS (SELECT * FROM claims WHERE subject_id = 20 OR object_id = 20 ORDER BY claim_id LIMIT 50)
    SELECT claim_id, predicate, relation, reference, CAST(n AS INT) AS nth FROM (SELECT s.claim_id, s.predicate, e.relation, coalesce(e.statement_id, e.passage_id) AS reference, row_number() OVER (PARTITION BY s.claim_id ORDER BY e.relation, coalesce(e.statement_id, e.passage_id), e.passage_id NULLS FIRST) AS n FROM star s JOIN (SELECT DISTINCT * FROM evidence) e ON e.claim_id = s.claim_id) AS x WHERE n <= 50"""


@archived
def migration_paths(d: Dialect) -> str:
    """Chains of recorded moves where the next begins where the last one ended, no event twice, within years; every beginning of a chain is one."""
    return """, m AS (SELECT * FROM migrations WHERE year BETWEEN 1710 AND 1850)
    SELECT 1 AS steps, migration_id AS first_event, migration_id AS last_event, from_place, to_place FROM m WHERE from_place < 30
      UNION ALL SELECT 2, a.migration_id, b.migration_id, a.from_place, b.to_place FROM m a JOIN m b ON b.from_place = a.to_place AND b.migration_id <> a.migration_id WHERE a.from_place < 30"""


@archived
def graph_statistics(d: Dialect) -> str:
    """What a graph answer shows: an edge is contested if any of its references refutes, references count once, and no more than 200 edges stay."""
    return """, e AS (SELECT c.claim_id, c.subject_id, c.object_id, c.status, count(DISTINCT v.passage_id) AS refs, coalesce(bool_or(v.relation = 'refutes'), false) AS refuted FROM claims c LEFT JOIN evidence v ON v.claim_id = c.claim_id WHERE c.subject_id < 60 GROUP BY c.claim_id, c.subject_id, c.object_id, c.status)
    SELECT subject_id, object_id, claim_id, refs, CASE WHEN refuted THEN 'contested' ELSE status END AS shown FROM (SELECT e.*, row_number() OVER (ORDER BY subject_id, object_id, claim_id) AS n FROM e) AS x WHERE n <= 200"""


@archived
def branch_structure_compare(d: Dialect) -> str:
    """Two trees by nodes, edges, leaves and how many children people have, those without any too; the second less the first."""
    return """, n AS (SELECT v.tree_id, x.person_id FROM nodes x JOIN versions v ON v.version_id = x.version_id WHERE v.version_number = 1 AND v.tree_id IN (0, 1)),
    k AS (SELECT v.tree_id, e.parent_id, count(*) AS children FROM edges e JOIN versions v ON v.version_id = e.version_id WHERE v.version_number = 1 AND e.predicate = 'parent_of' GROUP BY v.tree_id, e.parent_id),
    h AS (SELECT n.tree_id, coalesce(k.children, 0) AS children FROM n LEFT JOIN k ON k.tree_id = n.tree_id AND k.parent_id = n.person_id)
    SELECT children, sum(CASE WHEN tree_id = 0 THEN 1 ELSE 0 END) AS in_first, sum(CASE WHEN tree_id = 1 THEN 1 ELSE 0 END) AS in_second, sum(CASE WHEN tree_id = 1 THEN 1 ELSE -1 END) AS people_delta, sum(CASE WHEN tree_id = 1 THEN children ELSE -children END) AS edges_delta FROM h GROUP BY children"""


@archived
def edge_set_fingerprint(d: Dialect) -> str:
    """One digest for the edges of each version, whatever their order; a version's edges are a tree's."""
    key = "(parent_id || '>' || child_id || ':' || status)"
    joined = d.pick(f"sha2(array_join(sort_array(collect_set({key})), '||'), 256)", f"sha256(array_to_string(list_sort(list(DISTINCT {key})), '||'))")
    return f" SELECT version_id, {joined} AS fingerprint FROM edges GROUP BY version_id"


@archived
def statement_contradictions(d: Dialect) -> str:
    """Statements under one claim that both carry one of the terms and do not say the same words."""
    terms = ("the", "la", "der", "de")
    w = d.pick(f"array_sort(array_distinct({d.words('st.body')}))", f"list_sort(list_distinct({d.words('st.body')}))")
    carries = d.pick(f"arrays_overlap(w, array({', '.join(map(repr, terms))}))", f"list_has_any(w, {list(terms)!r})")
    return f", s AS (SELECT DISTINCT e.claim_id, st.statement_id, {w} AS w FROM evidence e JOIN statements st ON st.statement_id = e.statement_id), t AS (SELECT * FROM s WHERE {carries}) SELECT a.claim_id, a.statement_id AS a, b.statement_id AS b FROM t a JOIN t b ON b.claim_id = a.claim_id AND a.statement_id < b.statement_id WHERE a.w <> b.w"


# text and hashes

# Sample names for the normalisers, with marks, tatweel, letter forms, punctuation and digits.
NAMES = ("أَحْمَد بن عَلِيّ", "إبراهيم،  آل سعود", "مُحَمَّـــد ٱلأمين", "فاطمة-بنت ليلى", "أبو عبد الله الحسن", "أم كلثوم", "أبو بنت خالد", "عائشة (أم) ٣٢", "")
def names_sql(d: Dialect) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(NAMES)) + ") AS v(id, name))"


def replaced(d: Dialect, x: str, pattern: str, by: str) -> str:
    return d.pick(f"regexp_replace({x}, '{pattern.replace(chr(92), chr(92) * 2)}', '{by}')", f"regexp_replace({x}, '{pattern}', '{by}', 'g')")


@archived
def name_normalisers(d: Dialect) -> str:
    """Three forms of a name that must not be mixed: for search, for the assistant (wasla and punctuation stay), for routing."""
    ranges = "[\\x{0610}-\\x{061A}\\x{064B}-\\x{065F}\\x{0670}\\x{06D6}-\\x{06ED}ـ]"
    search = replaced(d, f"translate({replaced(d, 'lower(name)', '[' + chr(92) + 'p{Mn}ـ]', '')}, 'أإآٱىة', 'اااايه')", "[\\p{P}\\s]+", " ")
    assistant = replaced(d, f"translate({replaced(d, 'trim(name)', ranges, '')}, 'أإآىة', 'ااايه')", "\\s+", " ")
    routing = replaced(d, f"lower(translate({replaced(d, 'trim(name)', ranges, '')}, 'أإآٱىة', 'اااايه'))", "[\\p{P}\\s]+", " ")
    return f" SELECT id, trim({search}) AS search_form, trim({assistant}) AS assistant_form, trim({routing}) AS routing_form FROM {names_sql(d)} AS n"


@archived
def kunyah_names(d: Dialect) -> str:
    """The teknonym at the start of a name: the word, and the one after it (two, where that is a servant's name)."""
    part = lambda i: d.pick(f"get(t, {i - 1})", f"t[{i}]")
    split = d.pick("filter(split(trim(name), '\\\\s+'), w -> w <> '')", "list_filter(regexp_split_to_array(trim(name), '\\s+'), lambda w: w <> '')")
    second = part(2)
    blocked = " OR ".join(f"{d.pick('startswith', 'starts_with')}({second}, '{p}')" for p in ("بن", "بنت", "من", "و"))
    return f", w AS (SELECT id, {split} AS t FROM {names_sql(d)} AS n) SELECT id, {part(1)} || ' ' || CASE WHEN {second} = 'عبد' AND {d.size('t')} >= 3 THEN 'عبد ' || {part(3)} ELSE {second} END AS kunyah FROM w WHERE {d.size('t')} >= 2 AND {part(1)} IN ('أبو', 'أم') AND NOT ({blocked})"


@archived
def content_tokens(d: Dialect) -> str:
    """Words of a question without those that carry nothing of their own."""
    stop = ("the", "of", "and", "in", "to", "a", "de", "la", "le", "der", "die", "und", "el", "y", "que", "les")
    w = d.pick(f"array_sort(array_except(array_distinct({d.words('title')}), array({', '.join(map(repr, stop))})))", f"list_sort(list_filter(list_distinct({d.words('title')}), lambda x: NOT list_contains({list(stop)!r}, x)))")
    return f" SELECT question_id, {d.joined(w, ' ')} AS tokens FROM questions"


@query("name_spans")
def name_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name spans behind lineage markers: where one begins hangs on the words before it."""
    names = spark.createDataFrame(list(enumerate(NAMES)), "id int, name string")

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def spans(x: pd.Series) -> pd.Series:
        return x.map(matching.name_spans)

    return names.select("id", F.explode(spans("name")).alias("s")).select("id", "s.start", "s.stop")


@query("digest_embedding")
def digest_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen numbers from the SHA-512 of a benchmark text: the same for the same text, and nothing else. No meaning is in them."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", hashes.digest_embedding(F.trim(F.lower("text")), 16).alias("vector"))


@archived
def hash_embedding(d: Dialect) -> str:
    """Sixty-four numbers for a text: each word adds 1 to the bucket of its digest, each character a quarter to that of its low byte and place; unit length."""
    first = lambda digest: d.pick(f"CAST(conv(substr({digest}, 1, 2), 16, 10) AS INT) % 64", f"CAST(('0x' || substr({digest}, 1, 2)) AS INT) % 64")
    norm = f"trim({replaced(d, f'translate({replaced(d, chr(108) + 'ower(text)', chr(91) + chr(92) + 'p{Mn}ـ]', '')}, {chr(39)}أإآٱىة{chr(39)}, {chr(39)}اااايه{chr(39)})', '[' + chr(92) + 'p{P}' + chr(92) + 's]+', ' ')})"
    raw = d.pick("unhex(lpad(hex(ascii(substr(n, i, 1)) & 255), 2, '0') || lpad(hex(octet_length(substr(n, 1, i - 1)) % 251), 2, '0'))", "unhex(lpad(hex(unicode(substr(n, i, 1)) & 255), 2, '0') || lpad(hex(strlen(substr(n, 1, i - 1)) % 251), 2, '0'))")
    words = d.pick(f"transform(filter(split(n, ' '), w -> w <> ''), w -> {first('sha2(w, 256)')})", f"list_transform(list_filter(string_split(n, ' '), lambda w: w <> ''), lambda w: {first('sha256(w)')})")
    chars = d.pick(f"transform(sequence(1, length(n)), i -> {first(f'sha2({raw}, 256)')})", f"list_transform(range(1, length(n) + 1), lambda i: {first(f'sha256({raw})')})")
    count = d.pick("transform(sequence(0, 63), k -> size(filter(ws, x -> x = k)) + 0.25e0 * size(filter(cs, x -> x = k)))", "list_transform(range(64), lambda k: len(list_filter(ws, lambda x: x = k)) + 0.25e0 * len(list_filter(cs, lambda x: x = k)))")
    length = d.pick("sqrt(aggregate(v, 0.0e0, (s, x) -> s + x * x))", "sqrt(list_sum(list_transform(v, lambda x: x * x)))")
    unit = d.pick("transform(v, x -> round(x / l, 6))", "list_transform(v, lambda x: round(x / l, 6))")
    return f""", t AS (SELECT item_id, {norm} AS n FROM benchmark), b AS (SELECT item_id, {words} AS ws, {chars} AS cs FROM t WHERE n <> ''), v AS (SELECT item_id, {count} AS v FROM b), u AS (SELECT item_id, v, {length} AS l FROM v) SELECT item_id, {unit} AS embedding FROM u"""


# evaluation


@query("paired_bootstrap", f"""WITH RECURSIVE v AS (SELECT quality AS a, 1 - toxic AS b, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
k AS (SELECT 0::BIGINT AS step, {evaluation.SEED}::UHUGEINT AS s UNION ALL SELECT step + 1, (s * {evaluation.MULTIPLIER}::UHUGEINT + {evaluation.INCREMENT}::UHUGEINT) % 18446744073709551616::UHUGEINT FROM k WHERE step < 60 * (SELECT max(n) FROM v)),
r AS (SELECT CAST(floor((step - 1) / (SELECT max(n) FROM v)) AS BIGINT) AS sample, CAST(s % (SELECT max(n) FROM v)::UHUGEINT AS BIGINT) AS i FROM k WHERE step > 0),
m AS (SELECT sample, sum(a - b) / max(n) AS diff FROM r JOIN v USING (i) GROUP BY sample), o AS (SELECT list_sort(list(diff)) AS l FROM m)
SELECT round(l[CAST(round(0.025 * 59) AS INT) + 1], 6) AS low, round(l[CAST(round(0.975 * 59) AS INT) + 1], 6) AS high, (SELECT round(sum(a - b) / max(n), 6) FROM v) AS difference FROM o""")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % interval of a paired difference over sixty resamples drawn by a fixed generator; each sample's draws are made in a task of their own, from where the generator stands by then."""
    v = table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return evaluation.paired_bootstrap(global_rank(v, "doc_id").select((F.col("place") - 1).alias("i"), (F.col("a") - F.col("b")).alias("d")), 60)


DECISIONS = "dec AS (SELECT o_orderkey AS id, o_custkey % 10 AS file_id, o_orderkey % 9 <> 0 AS has_truth, o_orderkey % 7 AS shown, CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 5 < o_orderkey % 7 THEN o_orderkey % 5 ELSE 0 END AS rank, CASE WHEN o_orderkey % 4 = 0 THEN 'typed' ELSE 'picked' END AS method FROM orders)"


@archived
def candidate_metrics(d: Dialect) -> str:
    """How good shown candidates are, by file: recall, first, first three, mean reciprocal rank, and how often a person typed instead."""
    return f""", {DECISIONS} SELECT file_id, count(*) FILTER (WHERE has_truth) AS truths, count(*) FILTER (WHERE has_truth AND shown = 0) AS without_candidate, count(*) FILTER (WHERE has_truth AND rank > 0) AS recalled, count(*) FILTER (WHERE has_truth AND rank = 1) AS top1, count(*) FILTER (WHERE has_truth AND rank BETWEEN 1 AND 3) AS top3, count(*) FILTER (WHERE has_truth AND method = 'typed') AS typed,
      round(sum(CASE WHEN has_truth AND rank > 0 THEN 1.0e0 / rank ELSE 0.0e0 END) / count(*) FILTER (WHERE has_truth AND shown > 0), 6) AS mrr FROM dec GROUP BY file_id"""


@archived
def recall_by_class(d: Dialect) -> str:
    """Recall among the first five and mean reciprocal rank, for each class of case and for all."""
    return f""", {DECISIONS}, c AS (SELECT CASE file_id % 3 WHEN 0 THEN 'multi_hop' WHEN 1 THEN 'single_hop' ELSE 'lexical_control' END AS class, rank FROM dec WHERE has_truth), x AS (SELECT class, rank FROM c UNION ALL SELECT 'all', rank FROM c)
    SELECT class, count(*) AS cases, round(avg(CASE WHEN rank BETWEEN 1 AND 5 THEN 1.0e0 ELSE 0.0e0 END), 4) AS recall_at_5, round(avg(CASE WHEN rank > 0 THEN 1.0e0 / rank ELSE 0.0e0 END), 4) AS mrr FROM x GROUP BY class"""


@archived
def routing_accuracy(d: Dialect) -> str:
    """How often the route was the expected one, with both roundings of the 95 % interval."""
    def wilson(z: float) -> tuple[str, str]:
        z = f"{z}e0"
        mid, half = f"(h / n + {z} * {z} / (2 * n)) / (1 + {z} * {z} / n)", f"{z} * sqrt(h / n * (1 - h / n) / n + {z} * {z} / (4 * n * n)) / (1 + {z} * {z} / n)"
        return f"round(CASE WHEN n > 0 THEN greatest(0.0e0, {mid} - {half}) ELSE 0.0e0 END, 6)", f"round(CASE WHEN n > 0 THEN least(1.0e0, {mid} + {half}) ELSE 0.0e0 END, 6)"

    (a, b), (c, e) = wilson(numbers.Z95), wilson(numbers.Z95_LONG)
    return f""", x AS (SELECT conv_id % 4 AS grp, CAST(count(*) FILTER (WHERE turn >= 0) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE length(text) % 3 = 0) AS DOUBLE) AS h FROM conversations WHERE role = 'user' GROUP BY conv_id % 4 UNION ALL SELECT 9, 0.0e0, 0.0e0)
    SELECT grp, n, CASE WHEN n > 0 THEN round(h / n, 4) ELSE 0.0e0 END AS accuracy, {a} AS low, {b} AS high, {c} AS low_long, {e} AS high_long FROM x"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of drawn and found shapes and lines, made of a part's size and key; coordinates are shares of the page."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_size / 100.0D AS s", "(p_partkey % 17) / 100.0D AS d")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    s, d = F.col("s"), F.col("d")
    left = F.array(pt(s, s), pt(s + 0.3, s), pt(s + 0.4, s + 0.2), pt(s + 0.1, s + 0.3))
    right = F.array(pt(s + d, s), pt(s + 0.3 + d, s), pt(s + 0.4, s + 0.2 + d), pt(s + 0.1, s + 0.3))
    return p.select("id", left.alias("gold"), right.alias("found"))


@query("shape_agreement")
def shape_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap over union of two outlines, the Fréchet distance of the same points as lines, and whether the lines match either way around."""
    return shapes(spark, sf_dir).select("id", matching.shape_scores("gold", "found").alias("m")).select("id", F.round("m.iou", 6).alias("iou"), F.round("m.frechet", 6).alias("frechet"), "m.matches")


@query("document_bootstrap")
def document_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % interval of a ratio over whole documents, resampled by the standard library's seeded generator; a sample is a task's row."""
    counts = run(spark, sf_dir, " SELECT created_by AS document, count(*) AS total, count(*) FILTER (WHERE status = 'open') AS correct FROM questions GROUP BY created_by")
    return evaluation.document_bootstrap(counts, samples=100, seed=17)
