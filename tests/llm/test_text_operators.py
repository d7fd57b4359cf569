"""Token alignment, phrases and line quality: brute force, nulls, empty and long texts, repeats, ties, empty tables, clashing names."""

import hashlib
import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import alignment, phrases, quality
from chronoweave.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, chunk string, n bigint, f bigint"
LONG = "lorem ipsum dolor sit amet. " * 20_000
TEXTS = [
    (1, "The quick brown fox, jumps over the lazy dog"), (2, "The quick brown fox, jumps over the lazy dog"), (3, None), (4, ""), (5, " \n\t"), (None, "no id here <|endoftext|> <s> </s>"),
    (6, "one"), (7, "a▁b has the mark"), (7, "one two"), (8, LONG), (9, "Ünï 日本語 🙂 \n\n\x00 x" * 5), (9_007_199_254_740_993, "an id beyond the doubles"),
]


def docs(spark, rows=TEXTS, lang="en"):
    return spark.createDataFrame([(i, t, lang, None, None, "x", "y", 0, 0) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def sample(spark, sf_dir):
    """Rows of the given table: all of its texts."""
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


# 11: alignment

def by_hand(rows):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, sha256 of each row, token by token."""
    a_path, b_path = alignment.paths()
    pair = alignment.Pair(a_path, b_path)
    own, counts = [], Counter()
    for _, t in rows:
        a = pair.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pair.b.encode(t) if t else []
        want = (" " + (t or "")).encode()
        if b"".join(pair.a_bytes[i] for i in a) != want or b"".join(pair.b_bytes[i] for i in b) != want:
            a, b = [], []
        ends = [list(itertools.accumulate(len(t[i]) for i in ids)) for t, ids in ((pair.a_bytes, a), (pair.b_bytes, b))]
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        counts.update(links)
        own.append((len(a), len(b), groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(n_a, n_b, len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), sha(g)) for n_a, n_b, g, k in own]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_matches_brute_force(spark):
    want = Counter(zip([i for i, _ in TEXTS], by_hand(TEXTS)))
    for parts in (1, 5):
        got = alignment.alignment_summary(docs(spark).repartition(parts)).collect()
        assert Counter((r["id"], tuple(r[c] for c in COLUMNS)) for r in got) == want
    by_id = {i: w for (i, w) in want if i in (3, 4, 5, 7, None)}
    assert by_id[3] == by_id[4] == (0, 0, 0, 0, 0, 0, "") and by_id[5][2] > 0 and by_id[None][2] > 0
    assert [w for (i, w) in want if i == 7 and not w[0]]


def test_alignment_query(spark, sf_dir, sample):
    got = QUERIES["op11_token_alignment"](spark, sf_dir)
    assert got.columns[:1] == ["doc_id"] and {k for c, k in got.dtypes if c != "groups_sha256"} == {"bigint"}
    assert Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got.collect()) == Counter((i, *w) for (i, _), w in zip(sample, by_hand(sample)))


def test_aligned_groups_spell_the_texts(spark):
    a_path, b_path = alignment.paths()
    pair = alignment.Pair(a_path, b_path)
    for r in alignment.align_documents(docs(spark, TEXTS[:1] + TEXTS[2:])).collect():
        assert len(r["a_cut"]) == len(r["b_cut"]) and (not r["a"] or (r["a_cut"][-1], r["b_cut"][-1]) == (len(r["a"]), len(r["b"])))
        i = j = 0
        for x, y in zip(r["a_cut"], r["b_cut"]):
            assert b"".join(pair.a_bytes[k] for k in r["a"][i:x]) == b"".join(pair.b_bytes[k] for k in r["b"][j:y])
            i, j = x, y
    counts = alignment.link_counts(docs(spark)).toPandas()
    assert (counts.groupby("b_id")["count"].transform("max") == counts["count"]).equals(counts["best"]) and counts["count"].sum() == sum(w[3] for w in by_hand(TEXTS))


def test_alignment_encodes_each_part_once():
    pair = alignment.Pair(*alignment.paths())
    encode, seen = pair.encode, []

    def counted(texts):
        seen.extend(texts)
        return encode(texts)

    pair.encode = counted
    texts = [t for _, t in TEXTS] + ["one two  three\n four", "one two", " two\x85 one ", "one ▁ two", "two \u00a0 \u00a0one.\n\ntwo ", "\x1c one \x1f two", "two"] * 40
    got = alignment.align_batch(texts, pair)
    assert sum(map(len, seen)) < sum(len(t or "") for t in texts[: len(TEXTS) + 14])
    for i, t in enumerate(texts):
        [ids] = encode([t]) if t else [None]
        for flat, to, want in ((got.a, got.a_to, ids and ids[0]), (got.b, got.b_to, ids and ids[1])):
            assert flat[to[i - 1] if i else 0 : to[i]].tolist() == ([] if want is None else want.tolist())


def test_no_documents(spark):
    none = docs(spark).where("false")
    assert alignment.alignment_summary(none).count() == alignment.align_documents(none).count() == 0
    assert phrases.mine_phrases(none).count() == 0
    assert quality.assess(none, quality.no_chain()).count() == 0
    blank = docs(spark, [(1, None), (2, ""), (3, " . ")])
    assert phrases.mine_phrases(blank).count() == 0 and alignment.alignment_summary(blank.where("doc_id < 3")).agg(F.sum("n_links")).first()[0] == 0


# 12: phrases

def mined(rows, min_count, max_words, covered=50):
    f, n = Counter(), Counter()
    for lang, t in rows:
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, max_words + 1) for i in range(len(w) - m + 1))
    f = {k: v for k, v in f.items() if v >= min_count}
    out = []
    for (lang, w), a in f.items():
        longer = [v for (x, y), v in f.items() if x == lang and len(y) > len(w) and any(y[i : i + len(w)] == w for i in range(len(y) - len(w) + 1))]
        if len(w) > 1 and not any(100 * v >= covered * a for v in longer):
            score, _, left, right = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank = Counter()
    return [(r[0], rank.update([r[0]]) or rank[r[0]], *r[1:]) for r in out]


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("max_words", [2, 3, 5])
def test_phrases_match_brute_force(spark, monkeypatch, max_words, few):
    if not few:
        monkeypatch.setattr(phrases, "BROADCAST_NAMES", 0)
    rng = np.random.default_rng(8)
    words = ["A", "b", "é", "É", "dd", "e\x1ce", "x y"]
    rows = [("en" if rng.random() < 0.7 else "und", " ".join(rng.choice(words, rng.integers(0, 12), p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05])) + rng.choice([".", "! A b", "\t;", "\nb A", ""])) for _ in range(150)]
    rows += [("en", "only here once"), ("en", None), ("fr", "...")] + [("de", "der hund bellt")] * 12
    df = spark.createDataFrame([(i, t, None if x == "und" else x, None, 0, "x", "y", 0, 0) for i, (x, t) in enumerate(rows)], DOCS).repartition(5)
    got = [tuple(r) for r in phrases.mine_phrases(df, min_count=4, max_words=max_words, top=None).orderBy(F.col("lang"), "rank").collect()]
    assert got == mined(rows, 4, max_words) and len(got) > 20
    best = [tuple(r) for r in phrases.mine_phrases(df, min_count=4, max_words=max_words, top=3).collect()]
    assert sorted(best) == sorted(r for r in got if r[1] <= 3)


def test_phrase_query(spark, sf_dir):
    got = QUERIES["op12_phrases"](spark, sf_dir)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got.columns == names and [k for _, k in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = c.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['op12_phrases']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


# 13: line quality

def plain(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)


def test_counts_match_plain_rules(spark):
    rng = np.random.default_rng(9)
    rows = TEXTS + [(100 + k, "".join(rng.choice(["a", "b ", "c\n", " ", "\n", "\r", "\x1c", "é", "#", "\x0b"], rng.integers(0, 300)))) for k in range(200)]
    got = quality.assess(docs(spark, rows).repartition(3), quality.no_chain()).collect()
    fields = (*quality.COUNTS, "base_failed")
    assert Counter((r["id"], *(r[c] for c in fields)) for r in got) == Counter((i, *plain(t)) for i, t in rows)
    assert all(r["kept"] == (not r["base_failed"]) and r["boilerplate"] == [] for r in got)


def test_viterbi_and_likelihood_match_all_paths():
    rng = np.random.default_rng(10)
    length = np.array([6, 4, 4, 1])
    features = np.zeros((4, 6, len(quality.RANGES)), np.int32)
    for i, n in enumerate(length):
        features[i, :n] = rng.integers(0, quality.N_FEATURES, (n, features.shape[2]))
    chain = quality.Chain(rng.normal(size=quality.N_FEATURES), rng.normal(size=(2, 2)))
    marks = np.where(np.arange(6)[None] < length[:, None], rng.integers(0, 2, (4, 6)), 0)

    def score(c, i, path):
        return sum(c.weights[features[i, t]].sum() * m for t, m in enumerate(path)) + sum(c.steps[a, b] for a, b in zip(path, path[1:]))

    def value(c):
        return sum(score(c, i, marks[i, :n]) - np.log(sum(np.exp(score(c, i, p)) for p in itertools.product((0, 1), repeat=int(n)))) for i, n in enumerate(length))

    flat = np.concatenate([features[i, :n] for i, n in enumerate(length)])
    got, grad, steps = quality.log_likelihood(chain, flat, marks, length)
    assert abs(got - value(chain)) < 1e-9
    for k in rng.choice(quality.N_FEATURES, 8, replace=False):
        up = quality.Chain(chain.weights + 1e-5 * (np.arange(quality.N_FEATURES) == k), chain.steps)
        assert abs((value(up) - got) / 1e-5 - grad[k]) < 1e-3
    for i, j in itertools.product((0, 1), repeat=2):
        moved = chain.steps.copy()
        moved[i, j] += 1e-5
        assert abs((value(quality.Chain(chain.weights, moved)) - got) / 1e-5 - steps[i, j]) < 1e-3
    path = quality.viterbi(chain.weights[flat].sum(axis=1), chain.steps, np.repeat(np.arange(4), length))
    best = [max(itertools.product((0, 1), repeat=int(n)), key=lambda p: score(chain, i, p)) for i, n in enumerate(length)]  # noqa: B023
    assert path.tolist() == [m for p in best for m in p]
    assert quality.viterbi(np.zeros(4), np.zeros((2, 2)), np.array([0, 0, 1, 1])).tolist() == [0] * 4


def test_boilerplate_lines_are_found(spark):
    rng = np.random.default_rng(11)
    syllables = "ka lo mi re su ta ne vo di pa".split()

    def prose(n):
        return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n)) + "."

    def junk(n):
        return " ".join(f"{''.join(rng.choice(syllables, 2))}{rng.choice(['***', '$$$', '%%%'])}" for _ in range(n))

    rows = [(i, "\n".join(prose(rng.integers(17, 90)) for _ in range(3)), 1) for i in range(120)] + [(200 + i, "\n".join(rng.permutation([prose(8), prose(30), junk(rng.integers(20, 90)), junk(40)])), 0) for i in range(40)]
    new = [(500, "\n".join([prose(40), junk(10), prose(40)])), (501, "\n".join([junk(40), prose(20), junk(40)])), (502, prose(60)), (503, None)]
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (9999, 0), (0, None)], "doc_id bigint, quality int")
    chain = quality.train(docs(spark, [(i, t) for i, t, _ in rows]), labels)
    got = {r["id"]: r for r in quality.assess(docs(spark, new), chain).collect()}
    assert [got[i]["kept"] for i in (500, 501, 502, 503)] == [True, False, True, False]
    assert got[500]["boilerplate"] == [1] and got[501]["boilerplate"] == [0, 2] and got[502]["content_share"] == 1.0
    assert quality.train(docs(spark, new), labels.where("quality = 1")).weights.any() == 0


def test_quality_query(spark, sf_dir, sample):
    got = QUERIES["op13_line_quality"](spark, sf_dir)
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got.columns[:8] == ["doc_id", *fields, "kept"] and [k for _, k in got.dtypes[:8]] == [*["bigint"] * 6, "boolean", "boolean"]
    rows = got.collect()
    assert Counter((r["doc_id"], *(r[c] for c in fields)) for r in rows) == Counter((i, *plain(t)) for i, t in sample)
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_quality_holds_out(spark):
    """Learned from even ids, held against the odd ones."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    chain = quality.train(d, labels.where("doc_id % 2 = 0"))
    rows = quality.assess(d.where("doc_id % 2 = 1"), chain).join(labels, F.col("id") == F.col("doc_id")).where("NOT base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert len(good) > 100 and np.mean(good) > 0.99 and len(bad) > 5 and np.mean(bad) < 0.25
