"""Readers, sinks, the stream, and kernels with an order of decisions."""

import hashlib
import json
import math
import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import kinweave.plans  # noqa: F401
from kinweave.functions import hashes
from kinweave.operators import evaluation, geo, graph, indexes, matching, resolution
from kinweave.operators.ranking import global_rank
from kinweave.operators.setjoin import similar_sets
from kinweave.plans import registry
from kinweave.sources import readers
from kinweave.streaming import activity


def test_pages_back_off_to_white_space():
    text = "word " * 30
    pages = readers.cut_pages(text, 22)
    assert "".join(p[2] for p in pages) == text and all(len(p[2]) <= 22 for p in pages)
    assert all(p[2].endswith(" ") for p in pages)
    assert readers.cut_pages(None) == [(0, 0, "")] and [p[2] for p in readers.cut_pages("aaa\u00a0bbb\tccc", 8)] == ["aaa\u00a0bbb\t", "ccc"] and [len(p[2]) for p in readers.cut_pages("x" * 50, 20)] == [20, 20, 10]


def test_jsonl_and_ocr(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(json.dumps({"id": "a", "query": "q", "documents": [{"id": "d", "text": "t", "relevant": True}]}) + "\n")
    assert readers.jsonl(spark, str(tmp_path / "c.jsonl"), readers.RETRIEVAL_CASE).first()["documents"][0]["relevant"]
    head = "\t".join(c.split()[0] for c in readers.OCR_WORD.split(", "))
    (tmp_path / "o.tsv").write_text(f"{head}\n4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n5\t1\t1\t1\t1\t1\t10\t20\t30\t8\t91.5\tاسم\n")
    assert readers.ocr_words(spark, str(tmp_path / "o.tsv")).collect()[0]["right"] == 40


def test_append_new_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    path = str(tmp_path / "t")
    assert readers.append_new(df, path, ["k"]) == 2 and readers.append_new(df, path, ["k"]) == 0
    assert readers.append_new(spark.createDataFrame([(3, "c"), (2, "x")], df.schema), path, ["k"]) == 1
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_stream_of_windows(spark, sf_dir, tmp_path):
    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    src.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = activity.into_table(activity.windowed_counts(activity.events(spark, str(tmp_path / "in"), src.schema)), str(tmp_path / "out"), str(tmp_path / "check"))
        assert q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < got.agg({"n": "sum"}).first()[0] <= src.count() and got.dropDuplicates(["start", "event_type"]).count() == got.count()


def test_greedy_pairs():
    c = pd.DataFrame([(1, 5, 0.9), (1, 6, 0.8), (2, 5, 0.85), (2, 6, 0.1)], columns=["left", "right", "score"])
    assert matching.greedy_pairs(c)[["left", "right"]].to_numpy().tolist() == [[1, 5], [2, 6]]


def test_shapes():
    assert matching.frechet([(0, 0), (1, 0)], [(0, 1), (1, 1)]) == 1
    box = lambda x: [(x, 0), (x + 2, 0), (x + 2, 2), (x, 2)]
    assert matching.polygon_overlap(box(0), box(0)) == 1 and matching.polygon_overlap(box(0), box(1)) == pytest.approx(1 / 3, abs=0.03)


def test_frechet_and_match():
    line = np.array([(0.1, 0.1), (0.5, 0.2), (0.9, 0.1)])
    assert matching.frechet(line, line) == 0 and matching.paths_match(line, line[::-1]) and not matching.paths_match(line, line + 0.1)
    assert matching.frechet(line, line + [0.0, 0.02]) == pytest.approx(0.02) and not matching.paths_match(line[:1], line)
    assert matching.polygon_overlap(np.array([(0, 0), (0, 1), (0, 2)]), np.array([(0, 0), (0, 1), (0, 2)])) == 0


def test_merge_labels():
    b = pd.DataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 1, 0, 10, 10), (1, 3, 0, 1, 10, 10), (1, 4, 50, 50, 5, 5), (1, 5, 50, 50, 3, 3)], columns=["page", "id", "x", "y", "w", "h"])
    assert matching.merge_labels(b)[["id", "occurrences"]].to_numpy().tolist() == [[1, 3], [4, 2]]


def test_keep_best():
    from kinweave.plans.analysis_queries import keep_best

    b = pd.DataFrame([(1, 1, 0, 0, 10, 10, 0.5), (1, 2, 1, 0, 10, 10, 0.9), (1, 3, 30, 0, 10, 10, 0.1)], columns=["page", "id", "x", "y", "w", "h", "score"])
    assert keep_best(b)["id"].tolist() == [2, 3]


def test_loops_of_any_length():
    e = pd.DataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (5, 1), (7, 8), (8, 7), (9, 10)], columns=["a", "b"])
    assert graph.loops(e) == [(1, 2, 3, 4, 5), (7, 8)]


def test_cyclic_core(spark):
    e = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 3, 4), (1, 4, 5), (2, 1, 2), (2, 2, 2), (1, 0, 1)], "g long, a long, b long")
    assert sorted((r["g"], r["a"], r["b"]) for r in graph.cyclic_core(e, "g").collect()) == [(1, 1, 2), (1, 2, 3), (1, 3, 1)]


def test_budget_of_the_frontier(spark):
    steps = spark.createDataFrame([(0, i) for i in range(1, 6)] + [(i, 10 * i + j) for i in range(1, 6) for j in range(4)], "a long, b long")
    root = spark.createDataFrame([(0,)], "id long")
    got = graph.bounded_bfs(steps, root, 2, cap=9, budget=True).collect()
    assert sorted(r["id"] for r in got) == [0, 1, 2, 3, 4, 5, 10, 11, 12] and got[0]["truncated"]


def test_bootstrap_draws_are_the_generators():
    state, want = evaluation.SEED, []
    for _ in range(1000):
        state = (state * evaluation.MULTIPLIER + evaluation.INCREMENT) % evaluation.WORD
        want.append(state)
    assert [int(x) for block in evaluation.draws(evaluation.SEED, 1000, 64) for x in block] == want
    assert evaluation.jumped(evaluation.SEED, 137) == want[136]


def test_paired_bootstrap_sends_no_draws_through_the_driver(spark):
    n, samples = 50, 9
    d = [i % 3 - 1 for i in range(n)]
    got = evaluation.paired_bootstrap(spark.createDataFrame(list(enumerate(d)), "i long, d int"), samples, chunk=16)
    states = [int(x) for block in evaluation.draws(evaluation.SEED, n * samples) for x in block]
    means = sorted(sum(d[x % n] for x in states[k * n : (k + 1) * n]) / n for k in range(samples))
    low, high = (round(means[math.floor((samples - 1) * p + 0.5)], 6) for p in (0.025, 0.975))
    assert tuple(got.first()) == (low, high, round(sum(d) / n, 6))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_document_bootstrap(spark):
    rows = [(f"d{i}", i % 4, 4) for i in range(9)]
    got = evaluation.document_bootstrap(spark.createDataFrame(rows, "document string, correct long, total long"), 50, 17).first()
    rng, ratios = random.Random(17), []
    for _ in range(50):
        picks = [rows[rng.randrange(9)] for _ in rows]
        ratios.append(sum(p[1] for p in picks) / sum(p[2] for p in picks))
    ratios.sort()
    assert (got["low"], got["high"]) == (ratios[int(0.025 * 49)], ratios[int(0.975 * 49)]) and got["ratio"] == sum(r[1] for r in rows) / 36


def test_digest_vectors(spark):
    got = spark.createDataFrame([("abc",)], "t string").select(hashes.digest_embedding(F.col("t"), 70).alias("v")).first()["v"]
    digest = hashlib.sha512(b"abc").digest()
    assert got == [pytest.approx(round((digest[i % 64] + digest[(i * 7 + 13) % 64]) / 255 - 1, 6)) for i in range(70)]


def test_hash_embedding(spark, sf_dir):
    row = registry.QUERIES["hash_embedding"](spark, sf_dir).orderBy("item_id").first()
    text = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    plain = "".join(c for c in text.lower() if not unicodedata.category(c) == "Mn")
    plain = re.sub(r"[\s]+", " ", "".join(" " if unicodedata.category(c).startswith("P") else c for c in plain)).strip()
    v = [0.0] * 64
    for w in plain.split():
        v[hashlib.sha256(w.encode()).digest()[0] % 64] += 1
    for k, c in enumerate(plain):
        v[hashlib.sha256(bytes([ord(c) & 255, len(plain[:k].encode()) % 251])).digest()[0] % 64] += 0.25
    n = sum(x * x for x in v) ** 0.5
    assert row["embedding"] == pytest.approx([x / n for x in v], abs=1e-6)


def test_similar_sets_loses_none(spark):
    rng = random.Random(4)
    sets = {k: sorted(rng.sample(range(30), rng.randrange(0, 12))) for k in range(80)}
    got = {(r["a"], r["b"]) for r in similar_sets(spark.createDataFrame(list(sets.items()), "k long, t array<long>"), "k", "t", 0.5).collect()}
    jaccard = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 0
    assert got == {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.5}


def test_global_rank(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 7 % 10).alias("k"))
    got = {r["id"]: r["place"] for r in global_rank(df, "k", F.desc("id")).collect()}
    assert got == {i: n for n, (i) in enumerate(sorted(range(500), key=lambda i: (i * 7 % 10, -i)), 1)}
    assert global_rank(df.limit(0), "k").count() == 0


def test_points_within(spark):
    rng = random.Random(6)
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)] + [(200, 10.0, 179.9), (201, 10.0, -179.9), (202, 89.9, 0.0), (203, 89.9, 180.0)]

    def km(p, q):
        a, b = math.radians(p[1]), math.radians(q[1])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))

    got = {(r["a"], r["b"]) for r in geo.within(spark.createDataFrame(points, "k long, lat double, lon double"), "k", 900.0).collect()}
    assert got == {(p[0], q[0]) for p in points for q in points if p[0] < q[0] and km(p, q) <= 900}


def test_box_is_refused():
    with pytest.raises(ValueError):
        indexes.in_box(None, 10, 0, -10, 5)


def test_entity_scores(spark):
    people = [(1, "ali", "", 0, 100, None, None), (2, "ali", "", 0, 100, None, None), (3, "omar", "male", 90000, 90100, None, None), (4, "ali", "female", None, None, 10, None), (5, "ali", "male", None, None, None, 20)]
    p = spark.createDataFrame(people, "person_id long, normalized string, gender string, birth_from long, birth_to long, death_from long, death_to long")
    fact = lambda rows: spark.createDataFrame(rows, "person_id long, value string")
    facts = {k: fact([]) for k in resolution.SETS}
    facts["fathers"] = fact([(1, "a"), (2, "b"), (4, "a"), (5, "a")])
    snap = resolution.snapshot(p, **facts)
    assert snap.count() == 5
    got = {(r["a"], r["b"]): r for r in resolution.scored(spark.createDataFrame([(1, 2), (1, 3), (4, 5)], "a long, b long"), snap).collect()}
    # names and births agree, fathers do not: (.3 + .1) / .65, a conflict, but below the cap
    assert got[1, 2]["score"] == pytest.approx(0.4 / 0.65, abs=1e-6) and got[1, 2]["conflict"] and got[1, 2]["class"] == "possible"
    assert got[1, 3]["relationship"] is None and got[1, 3]["chronology"] == 0 and got[1, 3]["class"] == "likely_different"
    # all agrees but the gender: held down
    assert got[4, 5]["chronology"] == 0.0 or got[4, 5]["chronology"] > 0.99
    assert got[4, 5]["score"] == 0.49 and got[4, 5]["class"] == "likely_different"
    keys = {(r["kind"], r["key"]) for r in resolution.blocks(snap.where("person_id = 3")).collect()}
    assert keys == {("name", "omar"), ("date", "birth:240")}


def test_name_spans():
    text = "جاء محمد بن سعيد إلى ابن بن علي"
    assert [text[a:b] for a, b in matching.name_spans(text)] == ["بن سعيد", "بن علي"]


def test_shapes_that_come_again_are_scored_once(spark, monkeypatch):
    from kinweave.operators import matching

    pair = lambda k: ([{"x": 0.1, "y": 0.1}, {"x": 0.4, "y": 0.1}, {"x": 0.3, "y": 0.4 + k / 100}], [{"x": 0.1 + k / 50, "y": 0.1}, {"x": 0.5, "y": 0.1}, {"x": 0.3, "y": 0.4}])
    line = lambda s: np.array([(p["x"], p["y"]) for p in s])
    rows = [(i, *pair(i % 7)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, gold array<struct<x:double,y:double>>, found array<struct<x:double,y:double>>")
    want = [(matching.polygon_overlap(a, b), matching.frechet(a, b), matching.paths_match(a, b)) for a, b in ((line(x), line(y)) for x, y in map(pair, range(7)))]
    got = df.select("id", matching.shape_scores("gold", "found").alias("m")).collect()
    assert all((r["m"]["iou"], r["m"]["frechet"], r["m"]["matches"]) == want[r["id"] % 7] for r in got)
    times = []
    monkeypatch.setattr(matching, "shape_scored", lambda a, b: times.append(1) or (0.0, 0.0, False))
    columns = [[pd.Series([np.array([p[axis] for p in r[side]]) for r in rows]) for side in (1, 2) for axis in "xy"]]
    assert sum(len(x) for x in matching.scored_by_coordinates.func(iter(columns))) == 2000 and len(times) == 7


def test_merge_candidates_meet_on_name_and_tree_at_once(spark, tmp_path):
    """Of one name in many trees no pairs across trees are made."""
    import __spark_entry__

    spark.createDataFrame([(i, "Same Name", "brand", "type", 5, 1.0) for i in range(20000)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    df = __spark_entry__.queries()["merge_candidates"](spark, str(tmp_path))
    found = df.collect()
    assert len(found) == 100 and all(r["a"] // 50 == r["b"] // 50 == r["version_id"] // 10 and r["a"] < r["b"] for r in found)
    joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "normalized" in x]
    assert joins and all("version_id" in x for x in joins)


def vectors_with_ties(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)], rng.randrange(6)) for i in range(700)]
    rows += [(701, [0.0] * 4, 1), (702, None, 2), (703, [1.0, None, 2.0, 0.0], 3), (704, [1.0, 2.0], 4), (800, [1.0, 2.0, 0.0, 1.0], 77), (900, [2.0, 1.0, 1.0, -1.0], None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def slowly_ranked(df):
    from kinweave.functions.numbers import cosine

    a = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"), F.col("label").alias("l"))
    met = df.crossJoin(a).where("vec_id <> q").select("q", "vec_id", (F.col("label") == F.col("l")).alias("hit"), F.round(cosine(F.col("v"), F.col("embedding")), 6).alias("s"), F.col("embedding").isNotNull().alias("there"))
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "vec_id"))
    kept = F.row_number().over(Window.partitionBy("q", "there").orderBy(F.desc("s"), "vec_id"))
    return met.withColumns({"place": order, "nth": kept}).collect()


def test_first_hits_against_all_pairs(spark, monkeypatch):
    from kinweave.operators import vectors

    monkeypatch.setattr(vectors, "ROWS", 150)
    monkeypatch.setattr(vectors, "ASKED", 3)
    df = vectors_with_ties(spark)
    want = {}
    for r in slowly_ranked(df):
        want.setdefault(r["q"], None)
        if r["hit"]:
            want[r["q"]] = min(r["place"], want[r["q"]] or 10**9)
    asked = df.where("vec_id % 100 = 0").selectExpr("vec_id AS q", "embedding AS v", "label AS l")
    got = vectors.first_hits(df.selectExpr("vec_id AS id", "embedding AS vector", "label"), asked)
    assert {r["q"]: r["first"] for r in got.collect()} == want and want[800] is None and want[900] is None


def test_nearest_in_blocks_against_all_pairs(spark, monkeypatch):
    from kinweave.operators import vectors

    monkeypatch.setattr(vectors, "ROWS", 150)
    monkeypatch.setattr(vectors, "ASKED", 3)
    df = vectors_with_ties(spark)
    want = sorted((r["q"], r["vec_id"], r["s"], r["nth"]) for r in slowly_ranked(df) if r["there"] and r["nth"] <= 10)
    asked = df.where("vec_id % 100 = 0")
    got = indexes.nearest_exact(df, asked, "vec_id", "embedding", 10).collect()
    assert sorted(tuple(r[c] for c in ("query", "vec_id", "score", "place")) for r in got) == want
    even = df.where("size(embedding) = 4 AND NOT exists(embedding, x -> x IS NULL)")
    whole = indexes.nearest(indexes.cells(even, "vec_id", "embedding"), even.where("vec_id % 100 = 0"), "vec_id", "embedding", 10, share=1.0).collect()
    assert sorted(tuple(r[c] for c in ("query", "vec_id", "score", "place")) for r in whole) == sorted((r["q"], r["vec_id"], r["s"], r["nth"]) for r in slowly_ranked(even) if r["nth"] <= 10)


def test_similar_by_group_against_all_pairs(spark, monkeypatch):
    from kinweave.operators import setjoin

    monkeypatch.setattr(setjoin, "BLOCK", 7)
    rng = random.Random(8)
    base = [f"t{i}" for i in range(40)]
    rows = [(rng.choice(["s1", "s2", "s3", None]), sorted(set(base[: rng.choice([6, 30, 33])]) - {rng.choice(base) for _ in range(rng.randrange(4))})) for _ in range(90)] + [("s1", []), ("s2", []), ("s3", None)]
    want = {}
    for i, (g, x) in enumerate(rows):
        for h, y in rows[:i]:
            if g and h and g != h and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.86:
                want[min(g, h), max(g, h)] = want.get((min(g, h), max(g, h)), 0) + 1
    got = setjoin.similar_by_group(spark.createDataFrame(rows, "s string, g array<string>").repartition(3), "s", "g", 0.86).collect()
    assert want and {(r["a"], r["b"]): r["pairs"] for r in got} == want


def test_similar_by_group_in_cells_against_all_pairs(spark, monkeypatch):
    """Blocks by size that meet in cells: no pair is lost and none is made up."""
    from kinweave.operators import setjoin

    monkeypatch.setattr(setjoin, "BLOCK", 60)
    monkeypatch.setattr(setjoin, "LEAST", 10)
    rng = random.Random(9)
    kinds = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(60):
        whole = set(rng.sample(kinds, rng.choice([5, 40, 41, 150, 290])))
        rows += [(f"s{rng.randrange(4)}", sorted(whole - set(rng.sample(kinds, rng.choice([0, 10, 25, 60]))))) for _ in range(5)]
    rows += [(f"s{i % 3}", ["twin", "copy"]) for i in range(70)]
    want = {}
    for i, (g, x) in enumerate(rows):
        for h, y in rows[:i]:
            if g != h and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.86:
                want[min(g, h), max(g, h)] = want.get((min(g, h), max(g, h)), 0) + 1
    df = spark.createDataFrame(rows, "s string, g array<string>").repartition(3)
    assert {(r["a"], r["b"]): r["pairs"] for r in setjoin.similar_by_group(df, "s", "g", 0.86).collect()} == want
    assert setjoin.similar_by_group(df.where("s = 'none'"), "s", "g", 0.86).collect() == []


def one_block(setjoin, sets):
    often, times = np.unique(np.concatenate(sets), return_counts=True)
    frequent = often[np.argsort(-times, kind="stable")][: setjoin.BITS]
    n = np.array([len(x) for x in sets])
    sizes, counts = np.unique(n, return_counts=True)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([str(i) for i in range(len(sets))]), pa.array(sets, pa.list_(pa.int64())), pa.array(n, pa.int32())], ["k", "g", "t", "n"])
    return setjoin._Side(pa.Table.from_batches(setjoin._marks(frequent, sizes, np.cumsum(counts) - counts, counts, len(sets), [[0]])(iter([batch]))))


@pytest.mark.parametrize("bits", [64, 512, 8192])
def test_links_are_exact_with_tokens_that_have_no_bit(monkeypatch, bits):
    from kinweave.operators import setjoin

    for name, value in {"BITS": bits, "TILE": (16, 32), "VERIFIED": 5}.items():
        monkeypatch.setattr(setjoin, name, value)
    rng = random.Random(9)
    kinds = [rng.randrange(-(2**63), 2**63) for _ in range(2000)]
    sets = []
    for _ in range(40):
        whole = set(rng.sample(kinds, rng.choice([5, 40, 41, 600, 1500])))
        sets += [sorted(whole - set(rng.sample(kinds, rng.choice([0, 100, 150, 160, 170])))) for _ in range(5)]
    sets = [np.array(x) for x in sets if x]
    side = one_block(setjoin, sets)
    got = [tuple(sorted((int(side.groups[side.group[i]]), int(side.groups[side.group[j]])))) for x, y in setjoin._links(side, side, True, 0.86) for i, j in zip(x, y, strict=True)]
    want = {(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.86}
    assert want and len(got) == len(set(got)) and set(got) == want


def test_sketches_tell_most_pairs_apart(monkeypatch):
    """Of sets of common words hardly a pair is counted that doesn't link; every pair of two blocks was counted before, token by token."""
    from kinweave.operators import setjoin

    rng = np.random.default_rng(3)
    side, counted, kept = one_block(setjoin, [np.unique(rng.zipf(1.3, 900) % 3000) for _ in range(600)]), [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: counted.append(len(x)) or kept(x))
    links = sum(len(i) for i, _ in setjoin._links(side, side, True, 0.86))
    assert sum(counted) <= links + 600 * 599 / 2 / 100


def test_trigram_codes_are_the_engines_trigrams(spark):
    from kinweave.functions import text as T

    words = ["a", "ab", "straße", "عين", "𐐨𐐩x", "7"]
    codes, count = T.trigram_codes(pa.array(words))
    cuts = np.split(codes, np.cumsum(count)[:-1])
    got = [["".join(chr(c >> s & 0x1FFFFF) for s in (42, 21, 0)) for c in cut.tolist()] for cut in cuts]
    rows = spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", T.trigrams(F.col("w")).alias("g")).collect()
    assert [sorted(set(g)) for g in got] == [sorted(r["g"]) for r in sorted(rows, key=lambda r: r["i"])]
    assert all(len(x) == 0 for x in T.trigram_codes(pa.array([], pa.string())))
