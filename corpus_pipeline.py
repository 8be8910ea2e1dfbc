"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's docs.

Every stage works on all rows that its predecessor kept, and judges rows by their texts, so rows that share an
id, or have none, are judged one by one. Null and empty texts are scored by the classifier like any other, are
near duplicates of nothing, hold no benchmark item and no personal data, and have one segmentation, the empty
one. Repeated rows (id and text) are near duplicates of one another: one stays. Very long texts are read whole.
No documents, labels or benchmark items give no rejections. All stages but the last return the columns of
documents, whatever else these hold; the last returns columns of its own, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm import decontam, jaccard, nbest, pieces, pii, quality
from kinweave.llm.queries import TOKENIZERS
from kinweave.shared import drop_path, scratch_path, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id (a null one last), and one row of it.

    Groups are made of texts. A text goes by its doc_id, or, where that is null or another text has it too, by a
    64-bit hash that lies behind all ids. Texts without words are in no group and stay.
    """
    h = F.xxhash64("text")
    behind = h.bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    shared = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(h).alias("a"), F.max(h).alias("b")).where("a <> b").select("doc_id"), "shared_ids")
    if shared.isEmpty():
        texts = docs.select(F.coalesce("doc_id", behind).alias("doc_id"), "text")
    else:
        marked = docs.select("doc_id", "text").join(shared.withColumn("also", F.lit(True)), "doc_id", "left")
        texts = marked.select(F.when(F.col("also"), behind).otherwise(F.coalesce("doc_id", behind)).alias("doc_id"), "text")
    texts = texts.withColumn("h", h)
    found = jaccard.near_duplicates(texts.select("doc_id", "text")).where("n_shingles > 0").select("doc_id", "component_id").distinct()
    grouped = texts.groupBy("doc_id").agg(F.min("h").alias("h")).join(found, "doc_id").select("h", "component_id")
    who = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    rows = docs.select(who.alias("who"), h.alias("h"))
    first = rows.groupBy("h").agg(F.min("who").alias("who")).join(grouped, "h").groupBy("component_id").agg(F.min(F.struct("who", "h")).alias("first"))
    first = written(first.select("first.who", "first.h").distinct(), "first_of_groups")
    here = (docs["doc_id"].eqNullSafe(first["who.doc_id"])) & (F.xxhash64(docs["text"]) == first["h"])
    stay = docs.join(first, here, "left_semi")
    twice = written(rows.groupBy("who", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(first, ["who", "h"], "left_semi").select("who", "h"), "repeated_rows")
    if not twice.isEmpty():  # rows with one id and one text: the first one as JSON, so that any type of column can be in it
        name = "_" + "_".join(docs.columns)  # a name that no column has
        there = (stay["doc_id"].eqNullSafe(twice["who.doc_id"])) & (F.xxhash64(stay["text"]) == twice["h"])
        nth = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.to_json(F.struct(*docs.columns))))
        again = stay.join(twice, there, "left_semi").withColumn(name, nth).where(F.col(name) == 1).select(docs.columns)
        stay = stay.join(twice, there, "left_anti").unionByName(again)
    wordless = F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return stay.select(docs.columns).unionByName(docs.where(wordless))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a re-parameterised one, go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in every text."""
    return pii.masked(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, scores, ids_sha256, decoded_ok and the ids of the two best segmentations of each text.

    Written here, so that workers get a thousand texts at a time, and remember fewer words: executors come from four stages with full heaps.
    """
    return written(nbest.encode_documents(docs, pieces.load(f"{TOKENIZERS}/piece_bpe_32k.model"), n=2, most=150_000), "encoded", 1000)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece encoding", encoding_stage),
]

#: Trained models and a tokenizer are at work, so SQL can't say the same; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
