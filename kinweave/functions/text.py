"""Text scalars as native column expressions, and the two that need Python as pandas UDFs."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# The letters that name search treats as one, and marks that it drops.
ALEF_FORMS, ALEF = "أإآٱ", "ا"
YEH_FORM, YEH = "ى", "ي"
TEH_MARBUTA, HEH = "ة", "ه"
TATWEEL = "ـ"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
PARTICLES = ("ال", "بن", "بنت", "ابو")
NOT_WORD = "[^\\p{L}\\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased alphanumeric runs; null is no words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each padded with two spaces before and one behind."""
    def cut(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words(text), cut)))


def trigram_codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of each word as trigrams() cuts them, three code points in one number, and how many a word has."""
    points = np.frombuffer(("  " + "   ".join(words.to_pylist()) + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    count = length + 1
    at = np.arange(count.sum()) + np.repeat(2 * np.arange(len(words)), count)  # a word's padding has two more places than it has trigrams
    return points[at] << 42 | points[at + 1] << 21 | points[at + 2], count


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two arrays without repeats; 0 if both are empty. The arrays stand in a lambda, so that each is made once."""
    counts = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda x: F.struct(F.size(F.array_intersect(x["a"], x["b"])).alias("c"), (F.size(x["a"]) + F.size(x["b"])).alias("n")))
    return F.transform(counts, lambda x: F.when(x["n"] > x["c"], x["c"] / (x["n"] - x["c"])).otherwise(F.lit(0.0)))[0]


def similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def fold_arabic(text: Column) -> Column:
    """Search form without compatibility normalisation: marks and tatweel go, letter forms are one, punctuation is space."""
    t = F.regexp_replace(F.lower(text), "\\p{Mn}", "")
    t = F.translate(t, ALEF_FORMS + YEH_FORM + TEH_MARBUTA + TATWEEL, ALEF * len(ALEF_FORMS) + YEH + HEH)
    return F.trim(F.regexp_replace(t, "[\\p{P}\\s]+", " "))


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """Compatibility composition (NFKC), which the engine has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalise_name(text: Column) -> Column:
    return fold_arabic(compatible(text))


def canonical_key(text: Column) -> Column:
    """Folded name with western digits."""
    return F.translate(fold_arabic(text), ARABIC_DIGITS, "01234567890123456789")


def compact_key(text: Column) -> Column:
    return F.regexp_replace(canonical_key(text), "[ -]", "")


def particle_key(text: Column) -> Column:
    """Without up to two leading particles, and without a leading article on the first word left."""
    t = F.split(canonical_key(text), " ")
    lead = F.when(F.get(t, 0).isin(*PARTICLES) & F.get(t, 1).isin(*PARTICLES), 2).when(F.get(t, 0).isin(*PARTICLES), 1).otherwise(0)
    rest = F.array_join(F.slice(t, lead + 1, F.size(t)), " ")
    return F.regexp_replace(rest, f"^{PARTICLES[0]}(?=.)", "")


def edit_or_token_similarity(a: Column, b: Column) -> Column:
    """The larger of edit similarity and word-set similarity; equal texts 1, an empty side 0."""
    longest = F.greatest(F.length(a), F.length(b))
    edit = 1 - F.levenshtein(a, b) / longest
    tokens = set_similarity(F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " ")))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.greatest(edit, tokens))
