"""Round trips of files and reports."""

import json

import pytest
from pyspark.sql import functions as F

from chronoweave.sources import files, reports


def test_benchmark_array_and_lines(spark, tmp_path):
    items = [{"question": "q", "paragraphs": ["a", "b"], "answer": [1, 1], "split": "test"}]
    (tmp_path / "a.json").write_text(json.dumps(items, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(items[0]))
    for name in ("a.json", "b.json"):
        rows = files.read_benchmark(spark, str(tmp_path / name)).orderBy("idx").collect()
        assert [(r["paragraph"], r["is_gold"]) for r in rows] == [("a", False), ("b", True)]


def test_tuples(spark, tmp_path):
    rows = spark.createDataFrame([('a "x", y', "2020-01-01", "b", "2020-01-01", 0.95), ("c", "2020-01-01", "d", "2020-01-02", 0.1)], files.TUPLES)
    assert files.write_tuples(rows, str(tmp_path / "t")) == {"rows": 2, "similar": 1}
    assert sorted(files.read_tuples(spark, str(tmp_path / "t")).collect()) == sorted(rows.collect())


def test_cache(spark, tmp_path):
    pairs = spark.createDataFrame([("q", "a"), ("q", "b")], "question string, paragraph string")
    calls = []

    def compute(p):
        calls.append(1)
        return p.selectExpr("*", "1 AS score")

    path = files.cache_path(str(tmp_path), "b-full", "e", "org/model")
    for _ in range(2):
        assert files.cached_scores(spark, path, pairs, compute).count() == 2
    assert len(calls) == 1
    assert files.read_cache(spark, str(tmp_path / "none")) is None
    with pytest.raises(Exception):
        files.read_cache(spark, str(tmp_path / "none"), strict=True)


def test_report(spark, tmp_path):
    rows = [dict(zip(reports.COLUMNS, ("r", "hybrid", "t", "s", 0.6, "b", 3, 0.5, 0.25, 0.125, 0.1)))]
    (tmp_path / "r.md").write_text(reports.report(spark.createDataFrame(rows), ["b"]))
    back = reports.read_report(spark, str(tmp_path / "r.md")).collect()
    assert len(back) == 1 and back[0]["alpha"] == 0.6 and back[0]["num_queries"] == 3 and back[0]["mrr"] == 0.5


def test_config():
    c = reports.Config.parse('{"benchmarks": {"b": "p"}, "temporal_models": ["t"], "semantic_models": ["s"], "alphas": [0.5]}')
    assert [r[1] for r in c.runs()] == ["temporal", "semantic", "hybrid"]
    for bad in ('{"benchmarks": {}}', '{"benchmarks": {"b": "p"}, "alphas": [2]}', '{"benchmarks": {"b": "p"}, "x": 1}'):
        with pytest.raises(ValueError):
            reports.Config.parse(bad)
    assert reports.alpha_svg([{"run_type": "h", "alpha": 0.1, "mrr": 0.2}, {"run_type": "h", "alpha": 0.2, "mrr": 0.3}]).startswith("<svg")


def test_sql_functions(spark):
    from chronoweave.functions import sql

    sql.register(spark)
    r = spark.sql("SELECT day_index(DATE'2021-11-09'), round(temporal_similarity(365242, 365607, 365608, 365972), 6), temporal_kl(1, 2, 1, 2), cosine_similarity(array(1D, 0D), array(1D, 1D)), year_tokens('in 1999, 2005 and 1999'), squad_normalize('The  Cat, an a-b!')").first()
    assert tuple(r)[:3] == (373225, 0.142522, 0.0) and abs(r[3] - 0.5**0.5) < 1e-12 and r[4] == [1999, 2005] and r[5] == "cat ab"


def test_generate(spark):
    from pyspark.sql import functions as F

    from chronoweave.functions import temporal, text
    from chronoweave.operators import qa

    rows = spark.createDataFrame([(1, "q", ["A led it. Then", "B"])], "i int, question string, p array<string>")
    asked = rows.select("i", text.prompt(F.col("question"), F.col("p"), "s").alias("m"))
    assert qa.generate_answers(asked, "i", "m", qa.extract_first).first()["prediction"] == "A led it"
    assert [x["value"] for x in rows.select(temporal.tag_years(F.lit("1999 or 2001")).alias("t")).first()["t"]] == ["1999", "2001"]


def test_positions_of_whole_rows(spark):
    from chronoweave.operators import benchmarks, datagen

    rows = spark.range(150_000).select((F.hash("id") % 1000).alias("part"), "id", F.lit("x").alias("row"), F.rand(3).alias("place"), F.lit(None).cast("string").alias("k0"))
    placed = benchmarks.positions(rows, ["part", "id"])
    assert placed.columns == [*rows.columns, "position"]
    got = placed.toPandas().sort_values(["part", "id"])
    assert got["position"].tolist() == list(range(150_000)) and got["id"].nunique() == 150_000
    mixed = datagen.shuffled_union([rows.where("id < 100"), rows.where("id >= 100")], ["id"])
    assert mixed.agg(F.countDistinct("position"), F.min("position"), F.max("position")).first()[:] == (150_000, 0, 149_999)
    split = {r["split"]: r["count"] for r in benchmarks.contiguous_splits(rows, ["id"]).groupBy("split").count().collect()}
    assert split == {"train": 135_000, None: 12_000, "val": 1_500, "test": 1_500}


def test_cache_faults_are_raised(spark, tmp_path):
    from chronoweave.sources import files

    assert files.read_cache(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        files.read_cache(spark, str(tmp_path / "bad"))


def test_report_head_of_either_kind(spark):
    from chronoweave.sources import reports

    lines = ["| Run ID | " + " | ".join(reports.COLUMNS[1:]) + " |", "| run_id | " + " | ".join(reports.COLUMNS[1:]) + " |", "| a | b | - | c | 0.5 | q | 3 | 0.1 | 0.2 | 0.3 | 0.4 |"]
    got = reports.parse_rows(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["run_id"], r["alpha"]) for r in got] == [("a", 0.5)]
