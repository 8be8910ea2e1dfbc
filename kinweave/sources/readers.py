"""File sources and sinks beside Parquet tables. All paths go through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from kinweave.shared import written

RETRIEVAL_CASE = "id string, query string, documents array<struct<id: string, text: string, relevant: boolean>>"
OCR_WORD = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Labelled cases, one JSON object a line; the schema is given, never inferred."""
    return spark.read.schema(schema).json(path)


def ocr_words(spark: SparkSession, path: str, least: float = 0.0) -> DataFrame:
    """Words of an OCR engine's tab-separated output: page, line, box, confidence."""
    rows = spark.read.schema(OCR_WORD).option("sep", "\t").option("header", True).option("quote", "").csv(path)
    words = rows.where("level = 5 AND trim(text) <> ''").where(F.col("conf") >= least)
    return words.select("page_num", F.concat_ws(".", "block_num", "par_num", "line_num").alias("line"), "word_num", "text", "conf", "left", "top", (F.col("left") + F.col("width")).alias("right"), (F.col("top") + F.col("height")).alias("bottom"))


PAGE = ArrayType(StructType([StructField("page", IntegerType()), StructField("start", IntegerType()), StructField("text", StringType())]))


def cut_pages(text: str | None, most: int = 3500) -> list[tuple[int, int, str]]:
    """Pages of at most ``most`` code points; a page ends behind the last newline, space or tab in its last quarter, if there is one."""
    out, at, t = [], 0, text or ""
    if len(t) <= most:
        return [(0, 0, t)]
    while at < len(t):
        end = min(len(t), at + most)
        if end < len(t):
            least = at + most * 3 // 4
            end = max((t.rfind(c, least, end) for c in "\n \t"), default=-1) + 1 or end
        out.append((len(out), at, t[at:end]))
        at = end
    return out


def pages_of(text: Column, most: int = 3500) -> Column:
    """cut_pages() as a column: where a page ends depends on where the last one did, so rows are cut in Python."""
    return F.pandas_udf(lambda s: s.map(lambda t: cut_pages(t, most)), PAGE)(text)


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose key is not there yet, one a key; safe to repeat. Returns how many were new."""
    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        new = new.join(spark.read.schema(df.schema).parquet(path).select(keys), keys, "left_anti")
    new = written(new.select(df.columns), "new_rows")  # what is new is settled before the table changes
    new.write.mode("append").parquet(path)
    return new.count()
