"""The corpus pipeline, stage by stage, on planted documents."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = set(queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    draw = random.Random(2)
    vocabulary = ["".join(draw.choice("abcdefghiklmnoprstu") for _ in range(draw.randint(2, 9))) for _ in range(3000)]

    def prose(n):
        out = []
        while n > 0:
            k = min(n, draw.randint(6, 14))
            out.append(" ".join(draw.choice(vocabulary) for _ in range(k)).capitalize() + ".")
            n -= k
        return " ".join(out)

    docs = {i: prose(draw.randint(40, 200)) for i in range(60)}
    docs[60] = docs[5]
    docs[61] = docs[7] + " tail"
    docs[62] = " ".join(w + "###" for w in prose(80).split())
    bench = prose(30)
    docs[63] = prose(50) + " " + bench + " " + prose(20)
    docs[64] = prose(40) + " write to ada.lane@example.org now. " + prose(20)
    docs[65] = "short"
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(66, None, None, None, None), (67, "", "en", "s", 0)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs


def test_stages(spark, planted):
    folder, texts = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    left = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), "stage")
        assert docs.columns == columns
        left.append({r["doc_id"]: r["text"] for r in docs.collect()})
    gone = [set(texts) - set(left[0]), *(set(a) - set(b) for a, b in zip(left, left[1:]))]
    assert gone == [{62, 65}, {60, 61}, {63}, set()]
    changed = {i for i in left[3] if left[3][i] != left[2][i]}
    assert changed == {64} and "ada.lane" not in left[3][64]
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    pieces = corpus_pipeline.packing(spark, docs, folder).collect()
    assert {p["doc_id"] for p in pieces} == set(left[3])
    again = corpus_pipeline.run(spark, folder)
    assert {(p["doc_id"], p["start"], p["ids_crc32"]) for p in again.collect()} == {(p["doc_id"], p["start"], p["ids_crc32"]) for p in pieces}


def test_stages_carry_any_column(spark, planted):
    """Columns with a dot, a backtick's neighbours, or names that operators use themselves."""
    folder, texts = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("a.b", "n words", "kept", "_text", "_node", "quality"):
        docs = docs.withColumn(name, F.col("doc_id") * 2)
    for _, stage in corpus_pipeline.STAGES[:4]:
        before = docs.count()
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), "wide")
        assert docs.columns[-6:] == ["a.b", "n words", "kept", "_text", "_node", "quality"]
        assert docs.filter("`a.b` <> doc_id * 2 OR quality <> doc_id * 2").count() == 0 and 0 < docs.count() <= before
