"""What Parquet readers hold at once."""

from rasterloom.llm import common, quality


def test_readers_hold_few_texts_at_once(spark, data):
    """With Spark's 4,096 rows, long texts of a batch lay in one array of tens of MB."""
    spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = quality.keep_good(docs)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) == common.BATCH_ROWS <= 256
    assert 0 < kept.count() <= docs.count()
