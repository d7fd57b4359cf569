"""Generators and grounding are compiled, with the same results."""

from pyspark.sql import functions as F

from chronoweave.functions.temporal import ground
from chronoweave.operators import datagen


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_generators_are_compiled(spark):
    """Spark interprets what a generator computes itself, so it only takes columns that a projection has made."""
    entries = spark.range(3).select("id", F.lit("a b").alias("text"), F.array(F.lit("2004"), F.lit("2004-05")).alias("values"), F.lit("2005-06-07").cast("date").alias("dct"))
    for df in (datagen.synthetic_pairs(spark, 3), datagen.document_pairs(entries)):
        made = [line for line in _plan(df).splitlines() if "Generate " in line]
        assert made and not any("CASE" in line or "md5" in line for line in made)


def test_a_document_is_one_line_before_it_meets_expressions(spark):
    entries = spark.range(2).select("id", F.concat(F.lit(" a\n"), "id", F.lit(" ")).alias("text"), F.array(F.lit("2004")).alias("values"), F.lit("2005-06-07").cast("date").alias("dct"))
    df = datagen.document_pairs(entries)
    lines = _plan(df).splitlines()
    assert max(i for i, x in enumerate(lines) if "Generate explode" in x) < next(i for i, x in enumerate(lines) if "translate(" in x)
    assert {r["sent0"] for r in df.collect()} == {"a 0", "a 1"}


def test_bounds_of_odd_expressions(spark):
    forms = {
        "2004-02-29": ("2004-02-29", "2004-02-29"), "2005-02-29": None, "2004-02-29\n": None, " 2004-02-29": None, "2004-2-9": None, "2004-02": ("2004-02-01", "2004-02-29"), "2004-13": None, "0999": None, "1000": ("1000-01-01", "1000-12-31"),
        "2030-12-31": ("2030-12-31", "2030-12-31"), "2031": None, "2031-01": None, "1990s-mid": ("1994-01-01", "1996-12-31"), "2004,": None, ",2004": None, "2004,2005-02,x": ("2004-01-01", "2005-02-28"), "OFFSET P-3D": ("2005-06-04", "2005-06-04"), "OFFSET P30D": None, "": None,
    }
    rows = spark.createDataFrame([(f,) for f in forms], "e string").withColumn("g", ground(F.col("e"), F.lit("2005-06-07").cast("date")))
    assert {r["e"]: r["g"] and (str(r["g"]["start"]), str(r["g"]["end"])) for r in rows.collect()} == forms
