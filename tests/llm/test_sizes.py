"""What keeps the work of the corpus operators in proportion to their input."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from chronoweave.llm import embed_dedup, phrases, pii, shingles, simhash, sp_lattice, toxicity
from chronoweave.llm.common import Tables


def test_sample_of_shingles_grows_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(shingles, "SAMPLE", 50)
    counts = [shingles.sampled_rows(spark.range(n)).count() for n in (40, 6_000, 60_000)]
    assert counts[0] == 40
    assert 350 < counts[1] < 650 and 4_500 < counts[2] < 5_500
    assert shingles.sampled_rows(spark.range(0)).count() == 0


def test_vectors_of_floats_travel_in_four_bytes_a_component_and_lose_nothing():
    v = np.random.default_rng(1).normal(size=(50, 7)).astype(np.float32)
    sent = embed_dedup.packed(list(v), True)
    assert {len(x) for x in sent} == {28} and {len(x) for x in embed_dedup.packed(list(v), False)} == {56}
    back = np.frombuffer(b"".join(sent), np.float32).reshape(-1, 7)
    assert np.array_equal(embed_dedup.unit(back), embed_dedup.unit(list(v)))


def test_blocks_hold_fewer_long_vectors():
    assert [embed_dedup.rows_for(16_384, d) for d in (3, 64, 128, 4_096)] == [16_384, 16_384, 8_192, 2_048]


def test_lists_of_chunks_are_built_one_at_a_time(spark, monkeypatch):
    seen, put = {}, Tables.put

    def watched(self, name, df, *more):
        seen[name] = more
        return put(self, name, df, *more)

    monkeypatch.setattr(Tables, "put", watched)
    docs = spark.createDataFrame([("a b c a b c", "en")] * 12, "text string, lang string").repartition(4)
    before = spark.conf.get(phrases.LISTS_AT_ONCE)
    found = {r["phrase"]: r["a"] for r in phrases.mine_phrases(docs, covered=101).collect()}
    assert found == {"a b": 24, "b c": 24, "c a": 12, "a b c": 24, "b c a": 12, "c a b": 12}
    assert seen["pairs-2"] == seen["pairs-3"] == ({phrases.LISTS_AT_ONCE: "1"},)
    assert spark.conf.get(phrases.LISTS_AT_ONCE) == before


@pytest.mark.parametrize("build", [
    lambda docs: toxicity.scored(docs, toxicity.Model({}, 0.0)),
    lambda docs: simhash.fingerprints(docs),
    lambda docs: pii.redact_documents(docs),
    lambda docs: sp_lattice.encode_documents(docs, sp_lattice.model_path()),
])
def test_workers_get_small_batches_where_texts_share_nothing(spark, build):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    build(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 2 << 20


def _peak_mb(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_variants_are_made_and_met_in_little_memory():
    fps = np.random.default_rng(2).integers(0, 1 << 63, 2_000, dtype=np.uint64)
    made, peak = _peak_mb(lambda: [list(simhash._emit(fps, masks, 7)) for masks in (simhash._ONE, simhash._TWO)])
    assert peak < 60
    for rows, masks in zip(made, (simhash._ONE, simhash._TWO), strict=True):
        assert all(((v >> np.uint64(32)) * np.uint64(7) >> np.uint64(32) == b).all() for b, v, _ in rows)
        back = np.concatenate([(v * simhash._UNMIX) ^ masks[m] for _, v, m in rows])
        assert np.array_equal(np.sort(back), np.sort(np.repeat(fps, len(masks))))
    fps[1_000:] = fps[:1_000] ^ np.uint64(7)  # links of three bits
    even = fps[np.bitwise_count(fps) % 2 == 0]
    few = [(True, simhash._ONE, fps[a : a + 250]) for a in range(0, 2_000, 250)] + [(False, simhash._TWO, even[a : a + 50]) for a in range(0, len(even), 50)]
    bucket = pd.DataFrame([(near, simhash.store_sorted(v), m.tobytes()) for near, masks, own in few for _, v, m in simhash._emit(own, masks, 1)], columns=["near", "variants", "masks"])
    found, peak = _peak_mb(lambda: simhash._meet(bucket))
    assert peak < 25
    group = dict(zip(found["src"].to_numpy().view(np.uint64).tolist(), found["dst"].to_numpy().view(np.uint64).tolist(), strict=True))
    assert all(group.get(a, a) == group.get(b, b) for a, b in zip(fps[:1_000].tolist(), fps[1_000:].tolist(), strict=True))
