"""The pipeline's stages follow one another, work on what is left, and bear odd rows."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from rasterloom.llm import language, line_dedup, packing, quality, simhash


def test_pipeline_applies_its_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for step in (quality.keep_good, language.keep_identified, line_dedup.drop_repeated, simhash.keep_one):
        columns = docs.columns
        docs = step(docs)
        assert docs.columns == columns
    want = packing.pack_documents(docs).groupBy("doc_id").agg({"length": "sum"}).collect()
    got = corpus_pipeline.run(spark, data).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "line_dedup", "simhash_near_dedup", "packing"]


def test_pipeline_of_planted_rows(spark, data, tmp_path):
    """Exact and near copies, junk, nulls, repeated rows and clashing columns among the given documents."""
    given = spark.read.parquet(f"{data}/documents.parquet")
    rng = random.Random(12)
    words = sorted({w for r in given.where("lang = 'en'").orderBy("doc_id").limit(40).collect() for w in r.text.split() if w.isalpha() and w.islower()})
    prose = lambda n: ". ".join(" ".join(rng.choice(words) for _ in range(10)).capitalize() for _ in range(n)) + "."
    base, other = prose(20), prose(20)
    near = base.split()
    near[77] = "different"
    junk = " ".join("$$ ## BUY NOW !!! | >> || **"[k % 20 :] for k in range(200))
    planted = [(900_001, base), (900_002, base), (900_003, " ".join(near)), (900_004, other), (900_004, other), (900_005, junk), (900_006, None), (900_007, ""), (None, prose(15))]
    more = spark.createDataFrame(planted, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("planted"), "n_chars": F.length("text").cast(given.schema["n_chars"].dataType)})
    every = given.unionByName(more)
    for name in ("id", "score", "posterior", "component", "label", "group_id", "key", "row"):
        every = every.withColumn(name, F.lit("clash"))
    folder = str(tmp_path / "sf")
    every.write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()}
    assert {900_001, 900_004} <= got and not {900_002, 900_003, 900_005} & got
    clean = {r.doc_id for r in corpus_pipeline.run(spark, data).select("doc_id").distinct().collect()}
    assert len(clean - got) <= 2  # the planted rows do not drive out the others (an empty text of theirs may stand for one)


def test_pipeline_of_an_empty_table(spark, data, tmp_path):
    spark.read.parquet(f"{data}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
