"""Quality rules with host-level verdicts, in DataFrame functions only.

Every document is counted and judged by base rules; failures are then added up by host, each host's
failure rate is shrunk towards the corpus by a beta prior that is fitted to all hosts by moments, and
hosts whose shrunk rate is above ``max_rate`` lose all their documents.

Null and empty texts have no words and fail. Documents without a host take part in no host's rate and
get no host verdict. Repeated rows, and ids that are shared or null, count each time and come back as often. An
empty table has no hosts and no rows. Very long texts are read whole; other columns are not read, so they clash
with nothing. A hot host is only ever counted, with partial sums before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.shared import written

SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def counted(docs: DataFrame, host: str = "source", window: int = 8) -> DataFrame:
    """doc_id, host and the base counts of each whole text.

    Windows are told apart by a 64-bit hash within their own document. Their positions are sorted by
    hash inside the row, so that a row costs n log n and nothing is exploded.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.col(host).cast("string").alias("host"), text.alias("text"))
    words = base.select(
        "doc_id", "host",
        F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "").alias("words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, SPACES, "") != "").alias("lines"),
    )
    hashes = words.select(
        "doc_id", "host", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= window + 1, F.transform(F.sequence(F.lit(1), F.size("words") - window + 1), lambda i: F.xxhash64(F.slice("words", i, window)))).alias("h"),
    )
    repeated = hashes.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.size("h") > F.size(F.array_distinct("h")), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s"),
    )

    def at(i: Column) -> Column:
        return F.get("s", i)["x"]

    starts = repeated.withColumn("p", F.sort_array(F.transform(F.filter("s", lambda e, i: at(i - 1).eqNullSafe(e["x"]) | at(i + 1).eqNullSafe(e["x"])), lambda e: e["i"])))
    covered = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"), i.alias("last")))["n"]
    return starts.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def host_verdicts(counts: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """host, host_docs, host_failed, host_rate, host_ok: rates shrunk with a beta prior fitted by moments over all hosts.

    A host's say in the prior is the same whatever its size, but hosts of one document tell nothing of
    the spread between hosts and are left out of the fit (not out of the verdicts).
    """
    hosts = counts.where("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    rate = F.when(F.col("host_docs") > 1, F.col("host_failed") / F.col("host_docs"))
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    strength = F.when((F.col("v") > 0) & (F.col("m") > 0) & (F.col("m") < 1), F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(1.0))).otherwise(F.lit(1.0))
    prior = prior.select(F.struct(F.coalesce("m", F.lit(0.5)).alias("m"), F.least(strength, F.lit(1e6)).alias("k")).alias("prior"))
    shrunk = (F.col("host_failed") + F.col("p.m") * F.col("p.k")) / (F.col("host_docs") + F.col("p.k"))
    return hosts.withColumn("p", prior.scalar()).select("host", "host_docs", "host_failed", F.round(shrunk, 6).alias("host_rate"), (shrunk <= max_rate).alias("host_ok"))


def judge(docs: DataFrame, host: str = "source", min_words: int = 20, max_repeat_percent: int = 30, max_rate: float = 0.5) -> DataFrame:
    """One row for each document: counts, base_failed, host_rate, kept."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counts = written(counted(docs, host).withColumn("base_failed", failed), "host_counts")  # texts are read once
    # written, so that its size is known: small enough to broadcast, or joined by shuffles that can be split
    verdicts = written(host_verdicts(counts, max_rate).select("host", "host_rate", "host_ok"), "host_verdicts")
    return counts.join(verdicts, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).alias("kept"), "host_rate",
    )
