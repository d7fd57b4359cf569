"""Answers of the whole-set QA means are whole turns."""

from chronoweave.plans import texts


def test_answers_are_whole_turns(spark, tmp_path):
    long = "a turn of more than forty characters, whose end counts as well"
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "user", long)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = texts.qa_em_f1_containment(spark, str(tmp_path)).first()
    assert got["em"] > 0 and got["f1"] == got["em"]
