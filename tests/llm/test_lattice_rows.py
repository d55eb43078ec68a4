"""What travels with a word of a text."""

from pyspark.sql import functions as F

from rasterloom.llm import lattice


def test_kept_columns_do_not_travel_with_words(spark):
    rows = [(1, "one two two zyxwv", "a" * 50), (1, "one", "b"), (None, "", None), (2, " two  one", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    table = lattice.pieces(spark)
    encoded = lattice.encode(docs.repartition(3), table, keep=("extra",))
    plan = encoded._jdf.queryExecution().sparkPlan().toString()
    generated = [x for x in plan.splitlines() if "Generate posexplode" in x]
    assert generated and not any("extra" in x for x in generated)
    back = {(r.id, r.text, r.extra) for r in lattice.decode(encoded, table).collect()}
    assert back == {(i, t, e) for i, t, e in rows}
    many = docs.select("doc_id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(3000)), lambda i: F.conv(i * 7919, 10, 36))).alias("text"), "extra")
    assert {(r.id, r.text) for r in lattice.decode(lattice.encode(many, table), table).collect()} == {(r.doc_id, r.text) for r in many.collect()}
