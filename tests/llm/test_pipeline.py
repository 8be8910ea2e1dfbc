"""Each stage of the pipeline on its own input, and the whole of it."""

import random

import pyarrow as pa
import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(f"w{rng.randrange(900)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    root = tmp_path_factory.mktemp("sf")
    item = words(rng, 30)
    texts = [words(rng, 80) for _ in range(120)]
    texts += [" ".join(w + "###" for w in words(rng, 80).split()) for _ in range(60)]  # 120 to 179: poor
    texts += [texts[0], texts[1] + " more", words(rng, 40) + " " + item + " " + words(rng, 40), words(rng, 60) + " mail a.b@example.com now"]
    docs = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)] + [(7, texts[7], "en", "src3", len(texts[7])), (None, texts[3], "en", None, 1), (500, None, None, None, None)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    a = stages["quality classifier"](spark, docs, folder)
    assert a.columns == docs.columns
    kept = [r["doc_id"] for r in a.collect()]
    assert None in kept and not any(x is not None and 120 <= x < 180 for x in kept) and set(range(120)) <= set(kept)
    b = stages["n-gram jaccard join"](spark, docs, folder)
    left = sorted(r["doc_id"] for r in b.collect() if r["doc_id"] is not None)
    assert b.columns == docs.columns and left == [i for i in range(184) if i not in (180, 181)] + [500]
    c = stages["benchmark decontamination"](spark, docs, folder)
    assert c.columns == docs.columns and docs.count() - c.count() == 1 and 182 not in {r["doc_id"] for r in c.collect()}
    d = stages["pii"](spark, docs, folder)
    rows = {r["doc_id"]: r for r in d.collect()}
    assert d.columns == docs.columns and rows[183]["text"].endswith("mail <email> now") and rows[183]["n_chars"] == len(rows[183]["text"]) and rows[500]["text"] is None
    e = {r["doc_id"]: r for r in stages["sentencepiece encoding"](spark, docs, folder).collect()}
    assert all(r["decoded_ok"] for r in e.values()) and e[500]["n_pieces"] == [0] and len(e[0]["ids"]) == 2


def test_whole_pipeline(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    ids = sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None)
    assert set(range(120)) <= set(ids) and not {120, 179, 180, 181, 182} & set(ids) and 183 in ids and len(ids) == len(set(ids))


def test_rows_that_share_ids_and_odd_columns(spark, folder):
    rng = random.Random(77)
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    good = [words(rng, 80) for _ in range(6)]
    bad = " ".join(w + "###" for w in words(rng, 80).split())
    long = words(rng, 60_000) + " mail a.b@example.com"
    rows = [(1, good[0]), (1, bad), (1, good[1]), (2, good[0]), (None, good[0]), (None, good[2]), (None, good[2]), (3, good[3]), (3, good[3]), (4, good[4] + " " + item), (4, good[5]), (5, None), (5, ""), (None, None), (6, long), (7, "  \n")]
    rows += [(20 + k, words(rng, 80)) for k in range(40)] + [(130 + k, " ".join(w + "###" for w in words(rng, 80).split())) for k in range(40)]  # to learn from
    docs = spark.createDataFrame([(i, t, {"k": str(n)}, n, n, "x") for n, (i, t) in enumerate(rows)], "doc_id long, text string, _first map<string,string>, h long, component_id long, who string")
    stages = dict(corpus_pipeline.STAGES)

    def texts(name):
        got = stages[name](spark, docs, folder)
        assert got.columns == docs.columns
        return sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)

    def but(*gone):
        return sorted((x for k, x in enumerate(rows) if k not in gone), key=repr)

    assert (1, bad) not in texts("quality classifier") and {(1, good[0]), (1, good[1])} <= set(texts("quality classifier"))
    assert texts("n-gram jaccard join") == but(3, 4, 6, 8)
    assert texts("benchmark decontamination") == but(9)
    assert texts("pii") == sorted(((i, t and t.replace("a.b@example.com", "<email>")) for i, t in rows), key=repr)
    encoded = stages["sentencepiece encoding"](spark, docs, folder).collect()
    assert sorted((r["doc_id"] or 0) for r in encoded) == sorted((i or 0) for i, _ in rows) and all(r["decoded_ok"] for r in encoded)


def test_pipeline_without_rows(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_encoding_stage_takes_a_thousand_texts_at_a_time(spark, folder, monkeypatch):
    def sizes(docs, table, n, **how):
        assert how["most"] <= 200_000

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows]})

        return docs.mapInArrow(run, "rows long")

    monkeypatch.setattr(corpus_pipeline.nbest, "encode_documents", sizes)
    docs = spark.range(0, 2500, 1, 1).selectExpr("id AS doc_id", "'a b' AS text")
    got = [r["rows"] for r in corpus_pipeline.encoding_stage(spark, docs, folder).collect()]
    assert sum(got) == 2500 and max(got) <= 1000


def test_solvers_of_other_operators_are_put_away():
    from kinweave.llm import batches, pieces

    pieces.tool(lambda *_: "solver", pieces.PieceTable({}, [], [], [], 0.0, True, 0))
    assert batches.TOOLS is pieces.TOOLS and batches.TOOLS
    batches.put_away()
    assert not batches.TOOLS
