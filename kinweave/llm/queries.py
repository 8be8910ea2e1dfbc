"""One query for each operator of this subpackage, over its whole table; DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import decontam, host_rules, jaccard, nbest, pieces, pii, quality, sharding, substrings, token_counts, warc
from kinweave.shared import scratch_path, table

#: Where the vocabulary files are; read on the driver alone.
TOKENIZERS = os.environ.get("KINWEAVE_TOKENIZERS", "/opt/tokenizers")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of each text: ids, sizes, scores and digests, and whether the last decodes to the text."""
    return nbest.encode_documents(table(spark, sf_dir, "documents"), pieces.load(f"{TOKENIZERS}/piece_bpe_32k.model"), n=4)


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, len(words) AS n, p,
             count(*) OVER (PARTITION BY doc_id, array_to_string(words[p:p+7], ' ')) AS times
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS p FROM w WHERE len(words) >= 8)),
r AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM g WHERE times > 1) GROUP BY doc_id),
c AS (SELECT doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
h AS (SELECT host, count(*) AS nd, count(*) FILTER (WHERE base_failed) AS nf FROM f WHERE host IS NOT NULL GROUP BY host),
m AS (SELECT avg(nf / nd) FILTER (WHERE nd > 1) AS m, var_pop(nf / nd) FILTER (WHERE nd > 1) AS v FROM h),
k AS (SELECT coalesce(m, 0.5) AS m, least(CASE WHEN v > 0 AND m > 0 AND m < 1 THEN greatest(m * (1 - m) / v - 1, 1.0) ELSE 1.0 END, 1e6) AS k FROM m),
s AS (SELECT host, (nf + m * k) / (nd + k) AS rate FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(rate <= 0.5, true) AS kept, round(rate, 6) AS host_rate
FROM f LEFT JOIN s USING (host)
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), pieces.load(f"{TOKENIZERS}/piece_bpe_32k.model")).select("doc_id", "n_tokens", F.col("score"))


def op4_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to the shared folder and read back in ranges; what it returns is what the reader found."""
    archives = warc.write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.read_archives(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
t AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM t x JOIN t y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.reach) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY ALL
"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op10_flow_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laid out in 32 shards of files, brought to 40 there; what it returns is what lies in the files then."""
    folder = scratch_path(spark, "shards")
    schema = sharding.lay_out(table(spark, sf_dir, "documents"), folder, shards=32)
    sharding.reshard_files(spark, folder, schema, shards=40)
    old = sharding.old_layout(F.col("doc_id"), 32)
    there = sharding.laid_out(spark, folder, schema)
    return there.select("doc_id", sharding.size().alias("size"), sharding.checksum().alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), old.alias("old_shard"), (old != F.col("shard")).alias("moved"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_sentencepiece_nbest, op3_host_rules, op4_pii_bilstm_crf, op5_warc, op6_token_counts, op7_template_decontamination, op8_ngram_jaccard, op9_suffix_dedup, op10_flow_sharding)}
ORACLE = {"op3_host_rules": OP3_SQL, "op7_template_decontamination": decontam.sql(), "op8_ngram_jaccard": OP8_SQL}
