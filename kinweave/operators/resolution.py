"""Entity resolution: snapshot, blocks, pairs, scores and classes, all as array columns of one row a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import text

#: The weights of the six scores, and of the five relations within the third.
WEIGHTS = {"name": 0.30, "embedding": 0.15, "relationship": 0.25, "geography": 0.10, "chronology": 0.10, "source_context": 0.10}
RELATIONS = {"fathers": 0.40, "grandfathers": 0.25, "children": 0.15, "siblings": 0.10, "spouses": 0.10}
SETS = ("aliases", *RELATIONS, "places", "sources", "trees", "branches")
PER_BLOCK, MOST_PAIRS = 250, 1000


def snapshot(people: DataFrame, **facts: DataFrame) -> DataFrame:
    """people (person_id, normalized, gender, birth_from, birth_to, death_from, death_to) with a sorted array for each fact (person_id, value)."""
    out = people
    for name in SETS:
        got = facts[name].where("value IS NOT NULL").groupBy("person_id").agg(F.sort_array(F.collect_set(F.col("value").cast("string"))).alias(name))
        out = out.join(got, "person_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def _decades(kind: str, first: str, last: str) -> Column:
    """Ten-year keys over the span, at most 30 years of it; one bound stands for both. Days become years by 365."""
    a, b = (F.floor(F.coalesce(x, y) / 365) for x, y in ((F.col(first), F.col(last)), (F.col(last), F.col(first))))
    lo, hi = (F.floor(f(a, b) / 10) * 10 for f in (F.least, F.greatest))
    years = F.sequence(lo, F.least(hi, lo + 30), F.lit(10).cast("long"))
    return F.when(a.isNotNull(), F.transform(years, lambda y: F.struct(F.lit("date").alias("kind"), F.concat(F.lit(f"{kind}:"), y.cast("string")).alias("key"))))


def blocks(people: DataFrame) -> DataFrame:
    """person_id, kind, key: every block that a person is in, each once."""
    each = lambda kind, column: F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), F.trim(x).alias("key")))
    none = F.array().cast("array<struct<kind:string,key:string>>")
    parts = [F.array(F.struct(F.lit("name").alias("kind"), F.trim("normalized").alias("key")))]
    parts += [each(kind, F.col(c)) for kind, c in (("alias", "aliases"), ("father", "fathers"), ("grandfather", "grandfathers"), ("place", "places"), ("tree", "trees"), ("branch", "branches"))]
    parts += [_decades("birth", "birth_from", "birth_to"), _decades("death", "death_from", "death_to")]
    keys = F.array_distinct(F.concat(*[F.coalesce(p, none) for p in parts]))
    return people.select("person_id", F.explode(keys).alias("b")).select("person_id", "b.kind", "b.key").where("key <> ''")


def pairs(members: DataFrame, per_block: int = PER_BLOCK, most: int = MOST_PAIRS) -> DataFrame:
    """Pairs that share a block: the first members of each block by id, each pair once, the first ``most`` pairs by their key as text."""
    m = members.withColumn("n", F.row_number().over(Window.partitionBy("kind", "key").orderBy("person_id"))).where(F.col("n") <= per_block)
    met = m.select("kind", "key", F.col("person_id").alias("a")).join(m.select("kind", "key", F.col("person_id").alias("b")), ["kind", "key"]).where("a < b")
    return met.select("a", "b").distinct().orderBy(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"))).limit(most)


def _weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean over the parts that are there, weights shared out anew; null if none is."""
    total = sum(F.when(x.isNotNull(), weights[k]).otherwise(0.0) for k, x in parts.items())
    return F.when(total > 0, sum(F.coalesce(weights[k] * x, F.lit(0.0)) for k, x in parts.items()) / total)


def relationship(a: str = "_a", b: str = "_b") -> tuple[Column, Column]:
    """Score over the relations that both sides have (null if none), and whether any of these has nothing in common."""
    both = {k: (F.size(k + a) > 0) & (F.size(k + b) > 0) for k in RELATIONS}
    score = _weighted({k: F.when(both[k], text.set_similarity(F.col(k + a), F.col(k + b))) for k in RELATIONS}, RELATIONS)
    conflict = F.lit(False)
    for k in RELATIONS:
        conflict = conflict | (both[k] & ~F.arrays_overlap(k + a, k + b))
    return score, conflict


def _span(side: str, kind: str) -> tuple[Column, Column]:
    first, last = F.col(f"{kind}_from{side}"), F.col(f"{kind}_to{side}")
    return F.coalesce(first, last), F.coalesce(last, first)


def chronology() -> tuple[Column, Column]:
    """1 where births overlap (deaths, where a birth is missing), else less by the gap over 80 years, and a conflict; null if there are neither."""
    (ab, ae), (bb, be) = _span("_a", "birth"), _span("_b", "birth")
    (da, de), (db, dd) = _span("_a", "death"), _span("_b", "death")
    born = ab.isNotNull() & bb.isNotNull()
    first_a, last_a, first_b, last_b = (F.when(born, x).otherwise(y) for x, y in ((ab, da), (ae, de), (bb, db), (be, dd)))
    known = first_a.isNotNull() & first_b.isNotNull()
    gap = F.greatest(first_b - last_a, first_a - last_b)
    return F.when(known, F.when(gap <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - gap / 365 / 80))), F.coalesce(known & (gap > 0), F.lit(False))


def scored(found: DataFrame, people: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """a, b, the six scores, score, class, conflict. vectors: person_id, embedding of those who have one.

    The people of the pairs, at most two thousand, are picked before their sets and vectors are joined.
    """
    wanted = found.select(F.explode(F.array("a", "b")).alias("person_id")).distinct()
    people = people.join(F.broadcast(wanted), "person_id", "left_semi")
    if vectors is not None:
        people = people.join(vectors, "person_id", "left")
    else:
        people = people.withColumn("embedding", F.lit(None).cast("array<double>"))
    side = lambda s: people.select(*[F.col(c).alias(s if c == "person_id" else f"{c}_{s}") for c in people.columns])
    p = found.join(side("a"), "a").join(side("b"), "b")
    values = lambda s: F.concat(F.array(f"normalized_{s}"), f"aliases_{s}")
    name = F.array_max(F.flatten(F.transform(values("a"), lambda x: F.transform(values("b"), lambda y: text.edit_or_token_similarity(x, y)))))
    related, disjoint = relationship()
    timed, apart = chronology()
    either = lambda c: F.when((F.size(f"{c}_a") > 0) & (F.size(f"{c}_b") > 0), text.set_similarity(F.col(f"{c}_a"), F.col(f"{c}_b")))
    from kinweave.functions.numbers import cosine

    near = cosine(F.col("embedding_a"), F.col("embedding_b"))
    parts = {"name": name, "embedding": F.greatest(F.lit(0.0), F.least(F.lit(1.0), near)), "relationship": related, "geography": either("places"), "chronology": timed, "source_context": either("sources")}
    parts["embedding"] = F.when(near.isNotNull(), parts["embedding"])
    genders = (F.col("gender_a") != "") & (F.col("gender_b") != "") & (F.col("gender_a") != F.col("gender_b"))
    p = p.select("a", "b", *[x.alias(k) for k, x in parts.items()], (disjoint | apart | genders).alias("conflict"))
    raw = _weighted({k: F.col(k) for k in parts}, WEIGHTS)
    final = F.round(F.when(F.col("conflict") & (raw >= 0.78), 0.49).otherwise(raw), 6)
    kind = F.when(final >= 0.75, "strong").when(final >= 0.55, "possible").otherwise("likely_different")
    return p.select("a", "b", *[F.round(k, 6).alias(k) for k in parts], final.alias("score"), kind.alias("class"), "conflict")
