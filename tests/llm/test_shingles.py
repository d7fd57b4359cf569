"""Near-duplicates of the pipeline by the similarity of their shingles, against brute force."""

import numpy as np

from chronoweave.llm import shingles, simhash


def test_similar_documents_go(spark, monkeypatch):
    monkeypatch.setattr(shingles, "COMMON", 3)
    rng = np.random.default_rng(21)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = [" ".join(rng.choice(vocabulary, int(n))) for n in rng.integers(30, 400, 120)]
    for i in range(120):  # near copies on both sides of 0.8, chains of them, and texts inside longer ones
        w = texts[int(rng.integers(0, len(texts)))].split()
        for k in rng.integers(0, len(w), max(1, int(len(w) * rng.uniform(0, 0.03)))):
            w[k] = "changed"
        texts.append(" ".join(w if i % 3 else w[: int(len(w) * 0.82)]))
    texts += ["a common line that many texts hold " + " ".join(rng.choice(vocabulary, 3)) for _ in range(30)] + ["", None, "one", "One", "two words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [set(shingles.shingle_set(t, 5).tolist()) for t in texts]
    label = np.arange(len(texts))
    prints = [simhash.fingerprint(t, 5) for t in texts]
    near = np.array([[(x == y or (x and y and 10 * len(x & y) >= 8 * len(x | y))) or (a ^ b).bit_count() <= 3 for y, b in zip(sets, prints, strict=True)] for x, a in zip(sets, prints, strict=True)])
    for _ in texts:
        label = np.array([label[near[i]].min() for i in range(len(texts))])
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(df).collect())
    assert kept == np.flatnonzero(label == np.arange(len(texts))).tolist()
