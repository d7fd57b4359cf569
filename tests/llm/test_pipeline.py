"""The pipeline's stages on documents with planted cases."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(17)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(vocabulary, 120)) for _ in range(300)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, texts[i], "en", "s0", 1) for i in range(20)]  # copies
    rows += [(2000 + i, t + " vilename" * 3, "en", "s1", 1) for i, t in enumerate(" ".join(rng.choice(vocabulary, 120)) for _ in range(60))]
    rows += [(3000, " ".join(rng.choice(vocabulary, 50)) + " me@there.org", "en", "s2", 1), (3001, None, "en", None, None)]
    d = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(2000 <= i < 3000)) for i, *_ in rows if i % 2 == 0], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    seen = spark.read.parquet(f"{d}/documents.parquet")
    columns, after = seen.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen, d).write.parquet(f"{tmp_path}/{k}")
        seen = spark.read.parquet(f"{tmp_path}/{k}")
        after[name] = seen.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert seen.columns == columns
    ids = [r["doc_id"] for r in after["toxicity"]]
    assert not [i for i in ids if 2000 <= i < 3000] and len(ids) == 322
    ids = [r["doc_id"] for r in after["near_duplicates"]]
    assert sorted(ids) == [*range(300), 3000, 3001]
    cleaned = {r["doc_id"]: r for r in after["personal_data"]}
    assert len(cleaned) == 302 and cleaned[3000]["text"].endswith("[EMAIL]") and cleaned[3000]["n_chars"] == len(cleaned[3000]["text"]) and cleaned[0]["text"] == texts[0]
    words = {}
    for r in after["mix_sources"]:
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    total = sum(len((r["text"] or "").split()) for r in cleaned.values())
    assert abs(words["s0"] - total / 6) < 121 and abs(words["s1"] - total / 3) < 121 and abs(words["s2"] - total / 2) < 121
    assert all(r["exact"] for r in after["sentencepiece"]) and len(after["sentencepiece"]) == len(after["mix_sources"])
