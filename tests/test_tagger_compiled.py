"""What a tagger finds is grounded by compiled code."""

from pyspark.sql import functions as F

from chronoweave.operators import scoring


def test_grounding_is_compiled(spark):
    """Only offsets are grounded inside a lambda."""
    found = spark.createDataFrame([("q", "2004"), ("p", "2004-05-06")], "text string, expr string").withColumn("anchor", F.lit("2005-06-07").cast("date"))
    pairs = spark.createDataFrame([("q", "p")], "question string, paragraph string")
    for mode in ("max", "mean", "product", "merge", "union"):
        df = scoring.tagger_similarity(pairs, found, mode, "question", "paragraph", "text")
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert "transform(array(CASE WHEN RLIKE" not in text and "transform(array(coalesce(" not in text and df.count() == 1
