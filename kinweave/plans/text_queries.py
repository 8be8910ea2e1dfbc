"""Text scalars, search and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.functions import text as T
from kinweave.operators import search
from kinweave.operators.setjoin import similar_sets
from kinweave.plans.registry import query
from kinweave.shared import table
from kinweave.sources.domain import relation, with_relations

PHRASE = "the ing and that tion"


def grams(x: str) -> str:
    return f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def sets(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) + len({b}) - {common} > 0 THEN {common} / (len({a}) + len({b}) - {common}) ELSE 0.0 END)"


def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "people").select("name").distinct()


NEAREST = """SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings"""


@query("semantic_topk", f"SELECT * FROM ({NEAREST}) WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 20")
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.nearest(table(spark, sf_dir, "embeddings"), 0)


@query("lexical_rerank", f"""
WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS d, ['the', 'ing', 'and', 'that', 'tion'] AS q FROM benchmark),
s AS (SELECT item_id, round(len(list_intersect(q, d)) / len(q), 4) AS rerank FROM w)
SELECT item_id, rerank, row_number() OVER (ORDER BY rerank DESC, item_id) AS place FROM s""")
def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rerank(table(spark, sf_dir, "benchmark"), PHRASE, "text", "item_id")


@query("trigram_similarity_pairs", with_relations(f""", n AS (SELECT DISTINCT name, {grams('name')} AS g FROM people)
SELECT a.name AS a, b.name AS b, round({sets('a.g', 'b.g')}, 6) AS similarity FROM n a JOIN n b ON a.name < b.name WHERE {sets('a.g', 'b.g')} >= 0.5""", "people"))
def trigram_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of names over the threshold; they meet on their rare trigrams alone."""
    g = distinct_names(spark, sf_dir).withColumn("g", T.trigrams(F.col("name")))
    return similar_sets(g, "name", "g", 0.5).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("multiset_trigram_jaccard", with_relations(""", n AS (SELECT DISTINCT name, replace(name, ' ', '') AS t FROM people),
g AS (SELECT name, x AS gram, count(*) AS c FROM (SELECT name, unnest(CASE WHEN len(t) < 3 THEN [t] ELSE list_transform(range(1, len(t) - 1), lambda i: substr(t, i, 3)) END) AS x FROM n) GROUP BY ALL),
s AS (SELECT name, sum(c) AS n FROM g GROUP BY name),
p AS (SELECT a.name AS a, b.name AS b, sum(least(a.c, b.c)) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.name < b.name GROUP BY ALL)
SELECT a, b, round(c / (x.n + y.n - c), 6) AS similarity FROM p JOIN s x ON x.name = a JOIN s y ON y.name = b""", "people"))
def multiset_trigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpadded trigrams with their counts: sum of minima over sum of maxima."""
    t = distinct_names(spark, sf_dir).withColumn("t", F.replace("name", F.lit(" "), F.lit("")))
    cut = F.when(F.length("t") < 3, F.array("t")).otherwise(F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.substring(F.col("t"), i, F.lit(3))))
    g = t.select("name", F.explode(cut).alias("gram")).groupBy("name", "gram").agg(F.count(F.lit(1)).alias("c"))
    g = g.withColumn("n", F.sum("c").over(Window.partitionBy("name")))
    pairs = g.select(F.col("name").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), "gram").join(g.select(F.col("name").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), "gram"), "gram").where("a < b")
    shared = pairs.groupBy("a", "b", "na", "nb").agg(F.sum(F.least("ca", "cb")).alias("c"))
    return shared.select("a", "b", F.round(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), 6).alias("similarity"))


@query("levenshtein_token_similarity", with_relations(""", n AS (SELECT DISTINCT name FROM people),
p AS (SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON a.name < b.name AND split_part(a.name, ' ', 1) = split_part(b.name, ' ', 1))
SELECT a, b, round(greatest(1 - levenshtein(a, b) / greatest(len(a), len(b)), len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' '))))), 6) AS similarity FROM p""", "people"))
def levenshtein_token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = distinct_names(spark, sf_dir).withColumn("block", F.substring_index("name", " ", 1))
    pairs = n.select(F.col("name").alias("a"), "block").join(n.select(F.col("name").alias("b"), "block"), "block").where("a < b")
    return pairs.select("a", "b", F.round(T.edit_or_token_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


FOLD = "trim(regexp_replace(translate(regexp_replace(lower(name_ar), '\\p{Mn}', '', 'g'), 'أإآٱىةـ', 'اااايه'), '[\\p{P}\\s]+', ' ', 'g'))"


@query("name_keys", with_relations(f""", n AS (SELECT DISTINCT name_ar, {FOLD} AS k FROM people)
SELECT name_ar, k AS canonical, regexp_replace(k, '[ -]', '', 'g') AS compact, regexp_replace(k, '^ال(.)', '\\1') AS particle FROM n""", "people"))
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical, compact and particle-free keys of names in Arabic letters."""
    n = relation(spark, sf_dir, "people").select("name_ar").distinct()
    c = F.col("name_ar")
    return n.select("name_ar", T.canonical_key(c).alias("canonical"), T.compact_key(c).alias("compact"), T.particle_key(c).alias("particle"))


LADDER_SQL = "CASE WHEN name = 'red widget' THEN 100 WHEN replace(name, ' ', '') = 'redwidget' THEN 96 WHEN starts_with(name, 'red widget') THEN 92 WHEN starts_with(name, 'red') THEN 85 WHEN contains(name, 'red') THEN 72 - least(20, len(name) - 3) WHEN levenshtein(name, 'red widget') <= 2 THEN 66 - 8 * levenshtein(name, 'red widget') ELSE 0 END"


ROUTES = (("deep", "comparison", ("that", "than", "against")), ("deep", "path", ("from", "between", "von")), ("standard", "lookup", ("the", "der", "la")), ("light", "greeting", ("hello", "thanks")))


def route_sql() -> str:
    return "CASE " + " ".join(f"WHEN list_has_any(w, {list(terms)!r}) THEN '{route}/{reason}'" for route, reason, terms in ROUTES) + " WHEN len(w) > 40 THEN 'deep/long' ELSE 'light/default' END"


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered keyword rules; the first that holds gives route and reason."""
    w = T.words(F.col("text"))
    rule = None
    for route, reason, terms in ROUTES:
        hit = F.arrays_overlap(w, F.array(*map(F.lit, terms)))
        rule = (F.when if rule is None else rule.when)(hit, f"{route}/{reason}")
    rule = rule.when(F.size(w) > 40, "deep/long").otherwise("light/default")
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.length("text").alias("n"), rule.alias("rule")).select("conv_id", "turn", "n", F.substring_index("rule", "/", 1).alias("route"), F.substring_index("rule", "/", -1).alias("reason"))


ROUTED_SQL = f"SELECT conv_id, turn, n, split_part(rule, '/', 1) AS route, split_part(rule, '/', 2) AS reason FROM (SELECT *, {route_sql()} AS rule FROM (SELECT conv_id, turn, CAST(len(text) AS INT) AS n, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM conversations WHERE role = 'user'))"
query("routing_ladder", ROUTED_SQL)(routed)


@query("cost_by_route", f"""WITH r AS ({ROUTED_SQL}) SELECT route, count(*) AS cases, CAST(sum(units) AS BIGINT) AS units, CAST(sum(deep) AS BIGINT) AS if_all_deep FROM
 (SELECT route, CAST((1 + ceil(n / 1000)) * CASE route WHEN 'deep' THEN 8 WHEN 'standard' THEN 3 ELSE 1 END AS BIGINT) AS units, CAST((1 + ceil(n / 1000)) * 8 AS BIGINT) AS deep FROM r) GROUP BY route""")
def cost_by_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared units by route, and what they would be if all went the deep way."""
    size = 1 + F.ceil(F.col("n") / 1000)
    weight = F.when(F.col("route") == "deep", 8).when(F.col("route") == "standard", 3).otherwise(1)
    return routed(spark, sf_dir).groupBy("route").agg(F.count(F.lit(1)).alias("cases"), F.sum(size * weight).cast("long").alias("units"), F.sum(size * 8).cast("long").alias("if_all_deep"))


@query("routing_confusion", f"""WITH r AS ({ROUTED_SQL}) SELECT expected, route AS actual, count(*) AS n FROM (SELECT route, CASE WHEN n > 400 THEN 'deep' WHEN n > 120 THEN 'standard' ELSE 'light' END AS expected FROM r) GROUP BY ALL""")
def routing_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.when(F.col("n") > 400, "deep").when(F.col("n") > 120, "standard").otherwise("light")
    return routed(spark, sf_dir).groupBy(expected.alias("expected"), F.col("route").alias("actual")).agg(F.count(F.lit(1)).alias("n"))


@query("label_overlap_confidence", with_relations(""", n AS (SELECT DISTINCT name, string_split(name, ' ') AS w FROM people)
SELECT name, round(least(0.95, greatest(0.25, 0.25 + 0.7 * len(list_intersect(w, ['red', 'small', 'widget'])) / 3)), 4) AS confidence FROM n""", "people"))
def label_overlap_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.array(*map(F.lit, ("red", "small", "widget")))
    share = F.size(F.array_intersect(F.split("name", " "), label)) / 3
    return distinct_names(spark, sf_dir).select("name", F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.25), 0.25 + 0.7 * share)), 4).alias("confidence"))


@query("char_error_rate", with_relations(""", n AS (SELECT DISTINCT father, name FROM people)
SELECT father, CAST(sum(levenshtein(name, 'small red ring')) AS BIGINT) AS edits, CAST(sum(len('small red ring')) AS BIGINT) AS gold_chars, round(sum(levenshtein(name, 'small red ring')) / sum(len('small red ring')), 6) AS cer FROM n GROUP BY father""", "people"))
def char_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits over gold characters, by group."""
    gold = "small red ring"
    n = relation(spark, sf_dir, "people").select("father", "name").distinct()
    edits, chars = F.sum(F.levenshtein(F.col("name"), F.lit(gold))), F.sum(F.lit(len(gold)))
    return n.groupBy("father").agg(edits.cast("long").alias("edits"), chars.cast("long").alias("gold_chars"), F.round(edits / chars, 6).alias("cer"))


@query("page_windows", """
WITH d AS (SELECT doc_id, text, len(text) AS n FROM documents)
SELECT doc_id, CAST(i // 3500 AS INT) AS page, CAST(i AS INT) AS start, CAST(least(i + 3500, n) AS INT) AS stop, sha256(substr(text, i + 1, 3500)) AS digest FROM (SELECT *, unnest(range(0, greatest(n, 1), 3500)) AS i FROM d)""")
def page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows of 3500 code points with their offsets."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("n"))
    w = d.select("doc_id", "text", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n"), F.lit(1)) - 1, F.lit(3500))).alias("start"))
    return w.select("doc_id", (F.col("start") / 3500).cast("int").alias("page"), "start", F.least(F.col("start") + 3500, F.col("n")).alias("stop"), F.sha2(F.substring(F.col("text"), F.col("start") + 1, F.lit(3500)), 256).alias("digest"))


@query("html_titles", r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(html) - len(replace(html, '<a ', 'a ')) AS links FROM pages""")
def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), (F.length("html") - F.length(F.replace("html", F.lit("<a "), F.lit("a ")))).cast("long").alias("links"))
