"""The corpus operators on small tables: brute force, round trips, nulls, empty and long texts, repeats, ties, clashing names."""

import functools
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import ann, components, embed_dedup, lm_score, mixing, pii, simhash, sp_lattice, token_files, toxicity, url_filter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, chunk string, h string"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None, "x", "y", "z") for i, t, s in rows], DOCS)


LONG = "lorem ipsum dolor " * 40_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog", "a"), (2, "The quick brown fox jumps over the lazy dog", "b"), (3, None, None), (4, "", "a"), (5, " \n\t", "c"), (None, "no id here at all", None),
    (6, "one", "a"), (7, "one two", "b"), (7, "one two", "b"), (8, LONG, "c"), (9, "Ünï " * 5 + "日本語 ▁ \n\n  x", "c"), (10, "a@b.co 10.0.0.1 +1 555 123 4567", "d"),
    (9_007_199_254_740_993, "an id beyond the doubles", "d"),
]


# components

def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(1, 30)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame([*pairs, (None, 1)], "src bigint, dst bigint")).collect()}
    label = {x: x for p in pairs for x in p}
    for _ in label:
        new = dict(label)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    assert all(got.get(x, x) == label[x] for x in label)


def test_no_edges(spark):
    assert components.components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


# 1: SimHash

@pytest.mark.parametrize("bucket", [2_000_000, 5_000])
def test_links_match_brute_force(spark, bucket):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(x) for x in base}
    for x in base:
        for bits in range(1, 7):
            y = int(x)
            for b in rng.choice(64, bits, replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    f = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    label = np.arange(len(f))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(f))])
        if (new == label).all():
            break
        label = new
    found = simhash.links(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp bigint"), bucket_variants=bucket)
    got = {r["node"]: r["component"] for r in components.components(found).collect()}
    comp = [got.get(int(x), int(x)) for x in f.view(np.int64)]
    assert len(set(zip(comp, label.tolist()))) == len(set(comp)) == len(set(label.tolist()))


def test_simhash_edges(spark):
    rows = {(r["id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(docs(spark, ROWS)).collect()}
    by_id = {i: c for (i, _), c in rows.items()}
    assert by_id[1] == by_id[2] == 1 and by_id[3] == by_id[4] == by_id[5] == 3 and by_id[7] == 7
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    kept = simhash.drop_near_duplicates(docs(spark, ROWS))
    clash = simhash.drop_near_duplicates(docs(spark, ROWS).withColumn("_dropped", F.lit(1)).withColumn("dropped", F.lit(2)))
    assert clash.count() == kept.count()
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids.count("7") == 1 and "2" not in ids and "4" not in ids and "None" in ids and kept.columns == docs(spark, []).columns


def test_fingerprint_of_many_shingles(monkeypatch):
    import xxhash

    monkeypatch.setattr(simhash, "_STEP", 7)
    rng = np.random.default_rng(6)
    for n in (3, 4, 40, 333):
        words = rng.choice(["A", "b", "Cé", "d,", "E"], n).tolist()
        lower = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
        own = [xxhash.xxh64_intdigest(" ".join(lower[i : i + 3]).encode(), 42) for i in range(n - 2)]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))
        assert simhash.fingerprint(" \t".join(words)) == want


def test_fingerprint_of_short_texts():
    import xxhash

    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One") == xxhash.xxh64_intdigest(b"one", 42)


# 2: embeddings

def test_near_vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 8))
    x = np.vstack([x, x[:20] + rng.normal(size=(20, 8)) * 0.1, x[:5], x[:5] * 2])
    rows = [(i, [float(z) for z in v], "q") for i, v in enumerate(x)]
    bad = [(900, None, "q"), (901, [0.0] * 8, "q"), (902, [1.0, None] + [0.0] * 6, "q"), (903, [math.nan] * 8, "q"), (904, [math.inf] + [0.0] * 7, "q"), (None, [1.0] * 8, "q"), (905, [1.0, 2.0], "q")]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, id string")
    got = {r["id"]: r for r in embed_dedup.near_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([label[near[i]].min() for i in range(len(x))])
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum() - 1, label[i], label[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(900, 906)) and got[None]["component_id"] is None


def test_no_link_is_lost_between_cells(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", 6)
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    monkeypatch.setattr(embed_dedup, "VISITORS", 64, raising=False)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 64)) / 8
    x[:300] = x[0] / np.linalg.norm(x[0]) + rng.normal(size=(300, 64)) / 8 * 0.32  # one large group, near the threshold
    x[300:400] = x[400:500] + rng.normal(size=(100, 64)) / 8 * 0.4
    df = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r["id"]: r for r in embed_dedup.near_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    assert 30_000 < near[:300, :300].sum() < 89_000
    label = np.arange(len(x))
    for _ in range(30):
        label = np.array([label[near[i]].min() for i in range(len(x))])
    assert [got[i]["n_links"] for i in range(900)] == [near[i].sum() - 1 for i in range(900)]
    assert [got[i]["component_id"] for i in range(900)] == label.tolist()


# 3: language model

def test_lm_scores(spark):
    rows = [(1, "A b c a b", ""), (2, "a b c d", ""), (3, None, ""), (4, "zzz", ""), (5, "a b c d", "")]
    got = {r["id"]: r for r in lm_score.score_documents(docs(spark, rows)).collect()}
    texts = {i: (t or "").lower().split() for i, t, _ in rows}

    def grams(skip, n):
        return [tuple(w[k : k + n]) for i, w in texts.items() if i != skip for k in range(len(w) - n + 1)]

    for i, w in texts.items():
        total = 0.0
        for k in range(len(w)):
            p = max(grams(i, 1).count((w[k],)), 0.5) / max(1, len(grams(i, 1)))
            for n in (2, 3):
                if k >= n - 1:
                    c = grams(i, n).count(tuple(w[k - n + 1 : k + 1]))
                    p = c / grams(i, n - 1).count(tuple(w[k - n + 1 : k])) if c else 0.4 * p
            total += math.log(p)
        assert got[i]["n_words"] == len(w) and got[i]["log_score"] == pytest.approx(total)
    rng = np.random.default_rng(15)
    rows = [(i, " ".join(rng.choice(["a", "B", "c", "dd", "e"], int(rng.integers(0, 30)))), "") for i in range(200)]
    one = sorted((r["id"], r["n_words"], round(r["log_score"], 9)) for r in lm_score.score_documents(docs(spark, rows)).collect())
    many = sorted((r["id"], r["n_words"], round(r["log_score"], 9)) for r in lm_score.score_documents(docs(spark, rows), chunk_chars=200, bucket_keys=300).collect())
    assert one == many and len(one) == 200
    assert lm_score.score_documents(docs(spark, [])).count() == 0


# 4: personal data

def plain_spans(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    import random

    random.seed(1)
    for _ in range(20_000):
        t = "".join(random.choice("0123456789..@@ab +-() é") for _ in range(random.randint(0, 60)))
        assert sorted(plain_spans(t)) == sorted((a, b, k) for a, b, k, _ in pii.find_spans(t) if k in pii.BASE)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    found = pii.find_spans("IBAN GB82 WEST 1234 5698 7654 32, ssn 078-05-1120; number 078-05-1121" + " " * 80)
    assert [k for *_, k, _ in [(a, b, k, s) for a, b, k, s in found]][0] == "iban"
    assert not [k for _, _, k, _ in pii.find_spans("GB82 WEST 1234 5698 7654 33") if k == "iban"]


def test_added_spans():
    def kinds(t):
        return [(t[a:b], k) for a, b, k, _ in pii.find_spans(t) if k not in pii.BASE]

    assert kinds("GB82 WEST 1234 5698 7654 32 THANKS YOU") == [("GB82 WEST 1234 5698 7654 32", "iban")]
    assert kinds("DE89370400440532013000 BIC COBADEFF") == [("DE89370400440532013000", "iban")] and kinds("DE8937040044053201300 0X") == []
    assert kinds("ssn 078-05-1120") == [("078-05-1120", "ssn")] and kinds("078-05-1120") == kinds("000-00-0000 ssn") == kinds("lessn 078-05-1120") == []
    score = {t: pii.find_spans(t)[0][3] for t in ("ip 10.0.0.1", "ship 10.0.0.1")}
    assert score["ip 10.0.0.1"] == pytest.approx(1.0) and score["ship 10.0.0.1"] == pytest.approx(0.7)


def test_pii_query(spark, tmp_path):
    import hashlib

    docs(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op4(spark, str(tmp_path))
    assert got.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = got.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        text = next(t for i, t, _ in ROWS if i == r["doc_id"]) or ""
        own = sorted(plain_spans(text), key=lambda x: (x[0], pii.KINDS.index(x[2])))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in own).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[2] == k for x in own) for k in pii.BASE]


def test_pii_rows(spark):
    got = {r["id"]: r["spans"] for r in pii.pii_spans(docs(spark, ROWS)).collect()}
    assert [s["kind"] for s in got[10]] == ["email", "ip", "phone"] and got[3] == [] and None in got
    red = pii.redact_documents(docs(spark, ROWS))
    texts = {r["doc_id"]: r["text"] for r in red.collect()}
    assert texts[10] == "[EMAIL] [IP] [PHONE]" and texts[3] is None and red.columns == docs(spark, []).columns and red.count() == len(ROWS)


# 5: toxicity

def test_toxicity(spark):
    rng = np.random.default_rng(9)
    clean = [" ".join(rng.choice(["red", "green", "blue", "house", "tree", "river", "cloud"], 12)) for _ in range(900)]
    toxic = [c + " nastyword" + rng.choice(["s", "ed", "ing"]) for c in clean[:300]]
    rows = [(i, t, "s") for i, t in enumerate(clean + toxic)] + [(5000, None, "s"), (None, "red", "s")]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i >= 900)) for i in range(0, 1200, 2)] + [(7, 1, None), (None, 1, 1), (902, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["s"] for r in d.select("doc_id", toxicity.scored(d, toxicity.train(d, labels)).alias("s")).collect()}
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= 0.7) == (i >= 900) for i in held) and got[5000] < 0.7
    assert toxicity.train(d, labels.where("toxic = 0")).score("nastywords") == 0.0
    kept = toxicity.drop_toxic(d, labels)
    assert kept.count() == 902 and kept.columns == d.columns


# 6: nearest neighbours

def test_search(spark):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(size=(300, 16)), np.tile(rng.normal(size=16) * 3, (60, 1))])
    rows = [(i, [float(z) for z in v], 1) for i, v in enumerate(x)] + [(1000, None, 1), (1020, [0.0] * 16, 1), (1040, [math.nan] * 16, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, q int")
    got = ann.search(df, df["vec_id"] % 20 == 0, 20).toPandas()
    hits = 0
    for i in range(0, 360, 20):
        s = x @ x[i]
        s[i] = -np.inf
        best = np.lexsort((np.arange(360), -s))[:20]
        own = got[got["query_id"] == i].sort_values("rank")
        hits += len(set(best) & set(own["vec_id"]))
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own["score"], x[own["vec_id"]] @ x[i])
    assert hits >= 0.9 * 18 * 20 and set(got["query_id"]) == set(range(0, 360, 20))
    assert ann.search(df.where("vec_id >= 1000"), F.lit(True)).count() == 0


@pytest.mark.parametrize("noise", [0.29, 0.14])
def test_search_in_a_group_of_near_copies(spark, noise):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(3000, 64)) / 8
    x[:1000] = x[0] + rng.normal(size=(1000, 64)) / 8 * noise  # cosine about 0.92 and 0.98
    x[1000:1003] = x[0]
    df = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.search(df, df["vec_id"] % 50 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for i in range(0, 3000, 50):
        score = (x * x[i]).sum(axis=1)
        score[i] = -np.inf
        assert [got[i][k] for k in range(1, 21)] == np.lexsort((np.arange(3000), -score))[:20].tolist()


# 7: token files

def test_huffman():
    rng = np.random.default_rng(13)
    counts = np.r_[0, rng.integers(1, 10, 300), 10 ** rng.integers(0, 9, 40)]
    lengths = token_files.code_lengths(counts, 12)
    own = lengths[lengths > 0].astype(float)
    assert lengths.max() <= 12 and (2.0**-own).sum() <= 1 and len(own) == np.count_nonzero(counts)
    ids = rng.choice(np.flatnonzero(counts), 5000)
    lengths = token_files.code_lengths(counts)
    n = np.array([1, 127, 128, 129, 4615])
    data, marks = token_files.encode_documents(ids, n, lengths, token_files.canonical_codes(lengths))
    file = token_files.build_file([None, 1, 2, 3, 4], n.tolist(), data, marks)
    doc, back, decoded = token_files.read_file(file, *token_files.decode_table(lengths))
    assert (decoded == ids).all() and (back == n).all() and doc.tolist() == [token_files._NULL, 1, 2, 3, 4]
    assert token_files.code_lengths(np.array([0, 5])).tolist() == [0, 1]


def test_token_files(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    token_files.write_token_files(docs(spark, ROWS), str(tmp_path / "t"), path, file_ids=500)
    got = token_files.read_token_files(spark, str(tmp_path / "t"), with_ids=True).orderBy("start").collect()
    want = sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0])
    assert [r["id"] for r in got] == [r[0] for r in want] and got[0]["start"] == 0
    for g, (_, t, _) in zip(got, want, strict=True):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert g["ids"] == ids and g["n_tokens"] == len(ids) and g["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    token_files.write_token_files(docs(spark, []), str(tmp_path / "e"), path)
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("t", ["It's a <|endoftext|> test<|startoftext|>x Don't!! .,a ÀÉ é İ ẞ ﬁ 1234 a1b2 é! ≠ x y z\x1c. '''s we'll !?.,;:", "İ", "éẗ.", "ABC.def,GHI", ""])
def test_word_encoder(t):
    import public_tokenizers

    e = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert e.texts(pd.Series([t]))[0].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_known_words_are_not_encoded_again(monkeypatch):
    import public_tokenizers

    e = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    first = e.texts(pd.Series(["Lorem ipsum,", "dolor éclair***"]))[0]
    with monkeypatch.context() as m:
        for name in ("tokenizer", "model", "joined"):
            m.setattr(e, name, None, raising=False)
        assert e.texts(pd.Series(["ipsum LOREM éclair"]))[0].tolist() == e.texts(pd.Series(["IPSUM lorem Éclair"]))[0].tolist()
    assert first.tolist() == [*e.tokenizer.encode("Lorem ipsum,").ids, 1, *e.tokenizer.encode("dolor éclair***").ids, 1]
    monkeypatch.setattr(token_files, "KNOWN", 3, raising=False)
    for t in ("a bc def ghi a'b j' k_ l\\ m'' don't'", "n o p q r", "a bc def n'!#$%&*+/<=>?@[]^_`{|}~-", "é É. ü\"", "a bc"):
        assert e.texts(pd.Series([t]))[0].tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 1]
        assert len(e.known) <= 4  # four are from before the bound


# 8: SentencePiece

def best_path(pieces, known, word):
    path = [(0.0, 0, 0)]
    for b in range(1, len(word) + 1):
        options = []
        for a in range(max(0, b - pieces.longest), b):
            found = known.get(word[a:b]) or ((-1 - ord(word[a]), -1e12) if b == a + 1 else None)
            if found:
                options.append((path[a][0] + found[1], a, found[0]))
        path.append(max(options, key=lambda o: (o[0], o[1])))
    at, ids = len(word), []
    while at:
        ids.append(path[at][2])
        at = path[at][1]
    return pieces.expand(ids[::-1])


def test_sentencepiece(spark):
    rng = np.random.default_rng(12)
    letters = "".join(rng.choice(list("etaoinshrdlu"), 5_000))
    rows = ROWS + [(20, f"go {letters} and {letters[:256]} {letters[:257]} {letters[3:520]}", "a"), (21, "é" * 700 + "日本" * 300, "b"), (22, " " * 600 + "x", "b"), (23, "\x00 \x7f\r\n \U0001f600 e\u0301", "b")]
    rows += [(100 + i, " ".join(rng.choice(["alpha", "beta", "gamma,", "the", "(of)", "1.5", letters[i : i + 12]], 12)), "c") for i in range(60)]
    pieces = sp_lattice.Pieces(sp_lattice.model_path())
    known = {p: (i, s) for p, i, s in pieces.rows}
    encoded = sp_lattice.encode_documents(docs(spark, rows), sp_lattice.model_path())
    got = encoded.collect()
    assert all(r["exact"] for r in got) and len(got) == len(rows)
    texts = {i: t or "" for i, t, _ in rows}
    paths = {}
    for r in got:
        assert pieces.decode(r["ids"]) == texts[r["id"]]
        words = sp_lattice.words_of(texts[r["id"]])
        for w in set(words) - set(paths):
            paths[w] = best_path(pieces, known, w)
        assert r["ids"] == [i for w in words for i in paths[w]]
    back = sp_lattice.decode_documents(encoded.drop("exact"), sp_lattice.model_path())
    assert {r["id"]: r["text"] for r in back.collect()} == texts
    small = sp_lattice.encode_documents(docs(spark, rows).repartition(5), sp_lattice.model_path(), chunk_chars=100, bucket_chars=3_000)
    assert sorted(map(str, small.collect())) == sorted(map(str, got))
    assert sp_lattice.encode_documents(docs(spark, []), sp_lattice.model_path()).count() == 0


def test_parts_join_to_their_words_and_no_piece_spans_a_cut():
    pieces = sp_lattice.Pieces(sp_lattice.model_path())
    words = [" hello,", "\n", " 12345", "日本語", " a", "(x)[y]"]
    parts, n = pieces.parts(words)
    at = np.r_[0, np.cumsum(n)]
    assert ["".join(parts[a:b]) for a, b in zip(at, at[1:])] == words and len(parts) > len(words)
    texts = {p for p, _, _ in pieces.rows}
    for w, a, b in zip(words, at, at[1:]):
        cuts = set(np.cumsum([len(x) for x in parts[a:b]])[:-1].tolist())
        assert not any(w[i:j] in texts and any(i < c < j for c in cuts) for i in range(len(w)) for j in range(i + 2, len(w) + 1))


# 9: mixing

def test_targets_and_takes(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 4}") for i in range(400)] + [(1000, "big " * 5000, "s4"), (1001, None, None), (1002, "x " * 10, None), (1003, "", "s9")]
    d = docs(spark, rows)
    spans = mixing.mix_spans(d, block_words=64, blocks_per_shard=5).toPandas()
    again = mixing.mix_spans(d.repartition(7), block_words=64, blocks_per_shard=5).toPandas()
    taken = spans.assign(n=(spans["word_end"] - spans["word_start"]).fillna(0))
    assert taken.groupby("id")["n"].sum().to_dict() == again.assign(n=(again["word_end"] - again["word_start"]).fillna(0)).groupby("id")["n"].sum().to_dict()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    assert all(n <= 3 * size[i] for i, n in taken.groupby("id")["n"].sum().items()) and set(taken["id"]) == set(size)
    total = taken.groupby("source", dropna=False).agg(n=("n", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert ((total["n"] - total["target"]).abs() <= 0.5).all() and (total["target"] <= 3 * total["size"] + 1e-9).all()
    assert total["target"].sum() == pytest.approx(sum(size.values()))
    shards = taken[taken["n"] > 0].groupby("shard")["n"].sum()
    assert shards.max() <= 6 * 64 and sorted(shards.index) == list(range(int(shards.index.max()) + 1))
    mixed = mixing.mix_documents(d, block_words=64, blocks_per_shard=5)
    assert mixed.columns == d.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert mixing.mix_spans(docs(spark, [])).count() == 0 and mixing.mix_documents(docs(spark, [])).count() == 0


def test_hypergeometric(spark):
    rows = spark.range(4000).select(mixing.hypergeometric(F.lit(50).cast("bigint"), F.lit(20).cast("bigint"), F.lit(15).cast("bigint"), F.col("id")).alias("x"))
    mean, var, low, high = rows.agg(F.avg("x"), F.variance("x"), F.min("x"), F.max("x")).first()
    assert mean == pytest.approx(6, abs=0.1) and var == pytest.approx(15 * 0.4 * 0.6 * 35 / 49, rel=0.1) and low >= 0 and high <= 15


def test_large_hypergeometric_draws(spark):
    n, k, d = 40_000_000, 9_000_000, 30_000_000  # a standard deviation of 1,143
    rows = spark.range(8000).select(mixing.hypergeometric(*(F.lit(x).cast("bigint") for x in (n, k, d)), F.col("id")).alias("x"))
    sd = (d * k / n * (1 - k / n) * (n - d) / (n - 1)) ** 0.5
    mean, var, skew, kurt, odd = rows.agg(F.avg("x"), F.variance("x"), F.skewness("x"), F.kurtosis("x"), F.avg(F.col("x") % 2)).first()
    assert sd > mixing.INVERT_SD and mean == pytest.approx(d * k / n, abs=4 * sd / 8000**0.5) and var == pytest.approx(sd * sd, rel=0.08)
    assert abs(skew) < 0.12 and abs(kurt) < 0.25 and odd == pytest.approx(0.5, abs=0.03)


@pytest.mark.parametrize("quota", [1, 7, 640, 63 * 64, 5000])
def test_blocks_are_permuted_and_owned_once(spark, quota):
    targets = spark.createDataFrame([("a", 1, quota), (None, 2, 300), ("z", 3, 0)], "source string, sidx int, quota bigint")
    own = mixing.owned_blocks(targets, 42, 64, 5).toPandas()
    for sidx, q in ((1, quota), (2, 300)):
        part = own[own["sidx"] == sidx].sort_values("block")
        n = -(-q // 64)
        assert part["block"].tolist() == list(range(n)) and sorted(part["perm"]) == list(range(n))
        assert n < 20 or np.corrcoef(part["block"], part["perm"])[0, 1] < 0.5
    assert own.groupby("shard").size().max() <= 5 and not (own["sidx"] == 3).any()


def test_mix_query_counts_what_shards_own(spark, tmp_path, monkeypatch):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 4}") for i in range(400)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(mixing, "mix_spans", functools.partial(mixing.mix_spans, block_words=64, blocks_per_shard=5))
    whole = mixing.op9(spark, str(tmp_path))
    taken = whole.agg(F.sum("taken")).first()[0]
    assert whole.columns == ["doc_id", "size", "source_size", "target", "taken"] and abs(taken - 1597) <= 2
    real = mixing.shard_blocks
    monkeypatch.setattr(mixing, "shard_blocks", lambda *a: real(*a).where("not (sidx = 1 and perm = 0)"))
    assert mixing.op9(spark, str(tmp_path)).agg(F.sum("taken")).first()[0] < taken


def test_native_plan(spark):
    plan = mixing.mix_spans(docs(spark, ROWS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 10: URLs

def test_urls(spark):
    link = '<html><head><link href="{}" rel="canonical"></head>'
    rows = [
        (1, "http://Bad.COM/en/x#f", ""), (2, "https://alias.io/p", link.format("http://bad.com/en/x")), (3, "https://other.io/q?a=1", link.format("https://alias.io/p")),
        (4, "http://example.com/en/77", link.format("http://bad.com/en/x")), (5, "http://a.example.net/de/81", None), (6, "http://net/de/5", ""), (7, None, ""), (8, "no scheme", ""), (8, "no scheme", ""),
        (9, "http://combad.org/en/", ""), (10, "http://fr.org/es/1?x", '<meta http-equiv="refresh" content="0; url=/de/">'), (11, "http://fr.org/de/", ""), (12, "http://xcom/en/1", ""),
    ]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id bigint, url string, html string, host string")
    rules = spark.createDataFrame(list(url_filter.RULES), "verdict string, host string, path string")
    got = {r["page_id"]: (r["_host"], r["_path"], r["_rule"], r["_verdict"]) for r in url_filter.judge_pages(pages, rules).collect()}
    assert got[1] == ("bad.com", "/en/x", "com/en/", "block")
    assert got[2] == ("alias.io", "/p", None, "block") and got[3] == ("other.io", "/q", None, "block")
    assert got[4] == ("example.com", "/en/77", "example.com/en/7", "allow")
    assert got[5][2:] == ("example.net/de/8", "block") and got[6][2:] == ("net/de/", "allow")
    assert got[7] == got[8] == ("", "", None, "allow") and got[9][2:] == (None, "allow") and got[12][2:] == (None, "allow")
    assert got[10][2:] == ("org/es/", "block") and got[11][2:] == (None, "block")
    assert url_filter.judge_pages(pages, rules).count() == len(rows)
    assert url_filter.judge_pages(pages.limit(0), rules).count() == 0
    clash = url_filter.judge_pages(pages.withColumn("_host", F.lit(1)).withColumn("suffix", F.lit(2)), rules)
    assert clash.columns.count("_host") == 1 and {r["page_id"]: r["_host"] for r in clash.collect()}[1] == "bad.com"


def test_redirect_log(spark):
    pages = spark.createDataFrame([(1, "http://s.io/"), (2, "http://t.io/")], "page_id bigint, url string")
    rules = spark.createDataFrame([("block", "evil.biz", "/")], "verdict string, host string, path string")
    moves = spark.createDataFrame([("http://s.io", "http://evil.biz/x"), (None, "http://t.io/")], "src string, dst string")
    got = {r["page_id"]: r["_verdict"] for r in url_filter.judge_pages(pages, rules, moves, html=None).collect()}
    assert got == {1: "block", 2: "allow"}
