"""Ids, samples, libraries, histories and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.operators import matching
from kinweave.plans.registry import query
from kinweave.shared import table
from kinweave.sources import readers
from kinweave.sources.domain import relation, with_relations

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


@query("stable_ids", f"""WITH h AS (SELECT s_suppkey, sha1(from_hex('{URL_NAMESPACE}') || encode('supplier' || '|' || s_name)) AS x FROM supplier)
SELECT s_suppkey, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab', 1 + (instr('0123456789abcdef', substr(x, 17, 1)) - 1) % 4, 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS id FROM h""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 5 UUIDs of joined parts, in string functions."""
    x = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(F.concat_ws("|", F.lit("supplier"), "s_name"), "UTF-8")))
    h = table(spark, sf_dir, "supplier").select("s_suppkey", x.alias("x"))
    part = lambda a, n: F.substring("x", a, n)
    variant = F.substring(F.lit("89ab"), F.pmod(F.instr(F.lit("0123456789abcdef"), part(17, 1)) - 1, F.lit(4)) + 1, F.lit(1))
    return h.select("s_suppkey", F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12)).alias("id"))


@query("fnv_sample", """WITH h AS (SELECT c_custkey, list_reduce(list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM customer)
SELECT c_custkey, h FROM h WHERE h % 10 = 3""")
def fnv_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the rows by a 32-bit hash of their name: sampling is the feature."""
    chars = F.filter(F.split("c_name", ""), lambda c: c != "")
    h = F.aggregate(chars, F.lit(2166136261).cast("long"), lambda a, c: (a.bitwiseXOR(F.ascii(c).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295)))
    return table(spark, sf_dir, "customer").select("c_custkey", h.alias("h")).where("h % 10 = 3")


@query("decade_blocks", with_relations(" SELECT person_id, unnest(range(CAST(floor(birth_from / 10) AS BIGINT) * 10, least(CAST(floor(birth_to / 10) AS BIGINT) * 10, CAST(floor(birth_from / 10) AS BIGINT) * 10 + 30) + 1, 10)) AS decade FROM people", "people"))
def decade_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-year keys from first to last, four at most."""
    first, last = (F.floor(F.col(c) / 10) * 10 for c in ("birth_from", "birth_to"))
    return relation(spark, sf_dir, "people").select("person_id", F.explode(F.sequence(first, F.least(last, first + 30), F.lit(10).cast("long"))).alias("decade"))


@query("tree_library", with_relations(", v AS (SELECT parent_id % 5 AS tree, version_id, count(*) AS edges, count(*) FILTER (WHERE status = 'contested') AS unresolved FROM parent_of GROUP BY ALL) SELECT tree, version_id AS latest, edges, unresolved FROM v QUALIFY row_number() OVER (PARTITION BY tree ORDER BY version_id DESC) = 1", "parent_of"))
def tree_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each tree with its counts."""
    v = relation(spark, sf_dir, "parent_of").groupBy((F.col("parent_id") % 5).alias("tree"), "version_id").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("status") == "contested").alias("unresolved"))
    return v.groupBy("tree").agg(F.max(F.struct("version_id", "edges", "unresolved")).alias("x")).select("tree", F.col("x.version_id").alias("latest"), "x.edges", "x.unresolved")


@query("place_detail_union", with_relations(" SELECT place_id, person_id FROM visits WHERE kind = 'signup' UNION SELECT c.subject_id % 100, c.object_id FROM claims c WHERE c.predicate = 'R'", "visits", "claims"))
def place_detail_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = relation(spark, sf_dir, "visits").where("kind = 'signup'").select(F.col("place_id").cast("long").alias("place_id"), F.col("person_id").cast("long").alias("person_id"))
    c = relation(spark, sf_dir, "claims").where("predicate = 'R'").select((F.col("subject_id") % 100).alias("place_id"), F.col("object_id").alias("person_id"))
    return v.union(c).distinct()


@query("subject_migrations", with_relations(" SELECT visit_id, place_id, seen_at FROM visits WHERE person_id = 3 AND year(seen_at) BETWEEN 2020 AND 2030 ORDER BY seen_at, visit_id LIMIT 50", "visits"))
def subject_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "visits").where("person_id = 3 AND year(seen_at) BETWEEN 2020 AND 2030").select("visit_id", "place_id", "seen_at").orderBy("seen_at", "visit_id").limit(50)


@query("extraction_scores", """WITH x AS (SELECT l_returnflag AS kind, l_linenumber % 2 = 0 AS expected, l_quantity > 25 AS found FROM lineitem), s AS (SELECT kind, count(*) FILTER (WHERE expected AND found) AS tp, count(*) FILTER (WHERE found) AS pp, count(*) FILTER (WHERE expected) AS p FROM x GROUP BY kind)
SELECT kind, round(tp / pp, 6) AS precision, round(tp / p, 6) AS recall, round(2 * tp / (pp + p), 6) AS f1 FROM s""")
def extraction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, f = F.col("l_linenumber") % 2 == 0, F.col("l_quantity") > 25
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count_if(e & f).alias("tp"), F.count_if(f).alias("pp"), F.count_if(e).alias("p"))
    return s.select("kind", F.round(F.col("tp") / F.col("pp"), 6).alias("precision"), F.round(F.col("tp") / F.col("p"), 6).alias("recall"), F.round(2 * F.col("tp") / (F.col("pp") + F.col("p")), 6).alias("f1"))


@query("candidate_merge_rank", with_relations(""", g AS (SELECT decade, replace(name, ' ', '') AS key, count(*) AS n, count(DISTINCT father) AS files, max(birth_from) AS best FROM people GROUP BY ALL)
SELECT decade, key, n, files, CAST(row_number() OVER (PARTITION BY decade ORDER BY best DESC, files DESC, len(key), key) AS INT) AS place FROM g QUALIFY place <= 5""", "people"))
def candidate_merge_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with one match key become one; the best score, then the most files, then the shorter key."""
    g = relation(spark, sf_dir, "people").groupBy("decade", F.replace("name", F.lit(" "), F.lit("")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("father").alias("files"), F.max("birth_from").alias("best"))
    place = F.row_number().over(Window.partitionBy("decade").orderBy(F.desc("best"), F.desc("files"), F.length("key"), "key"))
    return g.select("decade", "key", "n", "files", place.alias("place")).where("place <= 5")


@query("weighted_map_mean", """SELECT user_id, round(sum(v * w) / sum(w), 6) AS mean FROM (SELECT user_id, value AS v, CASE event_type WHEN 'purchase' THEN 3.0 WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.5 END AS w FROM events) WHERE w IS NOT NULL GROUP BY user_id""")
def weighted_map_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights from a map; what has none is left out of both sums."""
    weights = F.create_map(F.lit("purchase"), F.lit(3.0), F.lit("click"), F.lit(1.0), F.lit("view"), F.lit(0.5))
    e = table(spark, sf_dir, "events").select("user_id", "value", F.try_element_at(weights, F.col("event_type")).alias("w")).where("w IS NOT NULL")
    return e.groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.col("w")) / F.sum("w"), 6).alias("mean"))


@query("quote_sentences", r"""SELECT item_id, trim(s) AS quote FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[.!?]\s')) AS s FROM benchmark) WHERE regexp_matches(lower(s), '(^|[^\p{L}])that([^\p{L}]|$)') AND len(trim(s)) <= 800""")
def quote_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of at most 800 characters with a marker as a whole word."""
    s = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "[.!?]\\s")).alias("s"))
    return s.where(F.regexp_like(F.lower("s"), F.lit("(^|[^\\p{L}])that([^\\p{L}]|$)")) & (F.length(F.trim("s")) <= 800)).select("item_id", F.trim("s").alias("quote"))


@query("split_pages")
def split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that end at white space; where one ends decides where the next begins, which SQL can't say."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(readers.pages_of(F.col("text"))).alias("p"))
    return d.select("doc_id", "p.page", "p.start", F.length("p.text").alias("n"))


@query("carrier_pairs")
def carrier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to one by falling score, within each page: a page's carriers are a bounded group a task."""
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 80).alias("page"), F.col("p_partkey").alias("id"), "p_size", "p_type")
    c = p.select("page", "p_type", F.col("id").alias("left"), F.col("p_size").alias("a")).join(p.select("page", "p_type", F.col("id").alias("right"), F.col("p_size").alias("b")), ["page", "p_type"]).where("left < right")
    c = c.select("page", "p_type", "left", "right", (1.0 / (1 + F.abs(F.col("a") - F.col("b")))).alias("score"))
    return c.groupBy("page", "p_type").applyInPandas(lambda g: matching.greedy_pairs(g), "left long, right long, score double")
