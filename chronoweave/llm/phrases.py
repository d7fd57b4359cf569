"""Phrases of words that stand together more often than their parts suggest, by hierarchical pair naming.

Texts are lower-cased (A-Z), split at punctuation and line ends into pieces and those into words. Words that are
frequent in their language get ids. Two neighbouring frequent phrases of k - 1 words, one word apart, are a phrase of k
words; distinct pairs of ids are counted over the corpus and the frequent ones get ids in their turn, which take the
places of the pairs in the texts for the next length. A phrase can't be more frequent than its parts, so none is lost.

A pair's two ids are its parents: the phrase without its last word and the one without its first. Along them each phrase gets the
counts of all its beginnings and ends, which are the parts of its cuts; and a phrase lies inside longer candidates
if it lies inside one that is one word longer, so its children alone decide whether it is dropped.

Texts are dealt with by chunks of some millions of characters: a chunk holds its texts as ids of its own, packed, and asks with one row for each distinct
word or pair, counted, so a frequent phrase is a row for each chunk. Names go back to the chunks by a join. Where the frequent ones
are few enough (counted) their table is broadcast, else both sides are shuffled; results are the same.

Nulls: a null text is empty, a null language is 'und'. Texts without words add nothing. Repeated rows count each. Ties in
score go to the larger count, then to the smaller phrase in byte order. Very long texts are one chunk each, whole. Only
text and language are read, so no other column's name can clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import expand, squeeze
from .common import Tables, batch_bytes, shuffle_parts, text_of, trim

BREAKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
MIN_COUNT, MAX_WORDS, COVERED, TOP, SCALE = 10, 3, 50, 2000, 1_000_000
#: Characters of a chunk, one text at least.
CHUNK_CHARS = 3_000_000
#: Named rows that may be broadcast, with both ids and the name 24 bytes each as data.
BROADCAST_NAMES = 1_000_000
#: How many groups' lists a task builds before it sorts its rows by group and builds one at a time. A chunk's list is some hundred thousand boxed numbers.
LISTS_AT_ONCE = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"


def _pack(seq: np.ndarray) -> bytes:
    return squeeze(np.ascontiguousarray(seq.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _whole(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _words(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """chunk, seq (words by place in the chunk's own list, from 1; 0 between pieces), left (language), right (word), n: a row a chunk."""
    batch_bytes(docs.sparkSession)

    def pack(chunk: int, texts: dict[str, list[bytes]]) -> pa.RecordBatch:
        seq, langs, words, counts, base = [], [], [], [], 0
        for lang, own in texts.items():
            tokens = b"\n".join([*own, b""]).lower().translate(BREAKS).replace(b".", b" . ").split()
            places = {w: i for i, w in enumerate(dict.fromkeys([b".", *tokens]))}
            at = np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens))
            n = np.bincount(at, minlength=len(places))[1:]
            seq.append(np.where(at > 0, at + base, 0))
            base += len(n)
            langs += [lang] * len(n)
            words += list(places)[1:]
            counts.append(n)
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int64()), pa.array([_pack(np.concatenate(seq))], pa.binary()), _whole(pa.array(langs, pa.string())), _whole(pa.array(words, pa.string())), _whole(pa.array(np.concatenate(counts), pa.int64()))],
            ["chunk", "seq", "left", "right", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for x in batches:
            texts: dict[str, list[bytes]] = {}
            size = 0
            for lang, t in zip(x.column("lang").to_pylist(), x.column("text").to_pylist(), strict=True):
                texts.setdefault(lang, []).append(t.encode())
                size += len(t)
                if size > CHUNK_CHARS:
                    yield pack(chunk, texts)
                    trim()
                    chunk, texts, size = chunk + 1, {}, 0
            if texts:
                yield pack(chunk, texts)
                trim()
                chunk += 1

    rows = docs.select(F.coalesce(docs[lang_col], F.lit("und")).alias("lang"), text_of(docs[text_col]).alias("text")).where("text != ''")
    return rows.mapInArrow(run, "chunk bigint, seq binary, left array<string>, right array<string>, n array<bigint>")


def _asked(level: DataFrame) -> DataFrame:
    """A row for each distinct pair of a chunk: chunk, pos (its place in the chunk's list), left, right, n."""
    return level.select("chunk", F.posexplode(F.arrays_zip("left", "right", "n")).alias("pos", "p")).select("chunk", "pos", "p.left", "p.right", "p.n")


def _named(level: DataFrame, min_count: int) -> DataFrame:
    """id, left, right, f of the pairs that the corpus holds min_count times or more."""
    f = _asked(level).groupBy("left", "right").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    numbered = f.select(F.monotonically_increasing_id().alias("m"), "left", "right", "f")
    parts, at = shuffle_parts(level.sparkSession), F.shiftright("m", 33)  # partitions are that many at most, so ids stay near the number of names
    return numbered.select(((F.col("m") - F.shiftleft(at, 33)) * parts + at).alias("id"), "left", "right", "f")


def _pairs(level: DataFrame, named: DataFrame) -> DataFrame:
    """The next level: names in the places of the level's pairs, and the distinct pairs of neighbouring names."""
    few = named.count() <= BROADCAST_NAMES
    names = named.select("id", "left", "right")
    known = _asked(level).select("chunk", "pos", "left", "right").join(F.broadcast(names) if few else names, ["left", "right"])
    told = known.groupBy("chunk").agg(F.collect_list("pos").alias("pos"), F.collect_list("id").alias("id"))
    rows = level.select("chunk", "seq").join(told, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                pos, own = (batch.column(c).slice(k, 1).flatten().to_numpy() for c in ("pos", "id"))
                ids, rank = np.unique(own, return_inverse=True)
                seq = _unpack(batch.column("seq")[k].as_py())
                place = np.full(max(int(seq.max(initial=0)), int(pos.max(initial=0)) + 1) + 1, -1, np.int64)
                place[pos.astype(np.int64) + 1] = rank
                at = place[seq]
                both = (at[:-1] >= 0) & (at[1:] >= 0)
                pairs, back, n = np.unique((at[:-1] * len(ids) + at[1:])[both], return_inverse=True, return_counts=True)
                out = np.zeros(len(both), np.int64)
                out[both] = back + 1
                left, right = ids[pairs // len(ids)], ids[pairs % len(ids)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("chunk").slice(k, 1), pa.array([_pack(out)], pa.binary()), *(_whole(pa.array(v, pa.int64())) for v in (left, right, n))], ["chunk", "seq", "left", "right", "n"]
                )
                del pos, own, ids, rank, seq, place, at, both, pairs, back, n, out, left, right
                trim()

    return rows.mapInArrow(run, "chunk bigint, seq binary, left array<bigint>, right array<bigint>, n array<bigint>")


def _joined(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Items one word longer: id, lang, words, f, heads (counts of the beginnings, shortest first), tails (of the ends, likewise)."""
    left = items.select(F.col("id").alias("left"), "lang", "words", F.col("f").alias("lf"), "heads")
    right = items.select(F.col("id").alias("right"), F.element_at("words", -1).alias("word"), F.col("f").alias("rf"), "tails")
    return pairs.join(left, "left").join(right, "right").select(
        "id", "left", "right", "lang", F.concat("words", F.array("word")).alias("words"), "f", F.concat("heads", F.array("lf")).alias("heads"), F.concat("tails", F.array("rf")).alias("tails")
    )


def phrase_tables(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """lang, n (all words); and for each length from 2 to max_words a table of the frequent phrases: id, left, right, lang, words, f, heads, tails."""
    tables = Tables(docs.sparkSession)
    level = tables.put("words", _words(docs, text_col, lang_col))
    total = tables.put("total", level.select(F.explode(F.arrays_zip("left", "n")).alias("p")).groupBy(F.col("p.left").alias("lang")).agg(F.sum("p.n").alias("n")))
    named = tables.put("names-1", _named(level, min_count))
    none = F.array().cast("array<bigint>")
    items, out, spent = named.select("id", F.col("left").alias("lang"), F.array("right").alias("words"), "f", none.alias("heads"), none.alias("tails")), [], "words"
    for k in range(2, max_words + 1):
        level = tables.put(f"pairs-{k}", _pairs(level, named), {LISTS_AT_ONCE: "1"})
        tables.drop(spent)
        spent = f"pairs-{k}"
        named = tables.put(f"names-{k}", _named(level, min_count))
        items = tables.put(f"items-{k}", _joined(named, items))
        out.append(items)
    tables.drop(spent)
    return total, out


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, covered: int = COVERED, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best `top` phrases (None: all); covered, in percent, drops phrases that longer ones cover."""
    total, lengths = phrase_tables(docs, text_col, lang_col, min_count, max_words)
    left = []
    for k, items in enumerate(lengths):
        if k + 1 < len(lengths):
            longer = lengths[k + 1].select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("most"))
            items = items.join(longer, "id", "left").where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("f")))
        score = f"(cast({SCALE} as decimal(38,0)) * cast(f as decimal(19,0)) * f) div (cast(element_at(heads, k) as decimal(19,0)) * cast(element_at(tails, {k + 2} - k) as decimal(19,0)))"
        worst = F.expr(f"array_min(transform(sequence(1, {k + 1}), k -> struct({score} as score, k, element_at(heads, k) as l, element_at(tails, {k + 2} - k) as r)))")
        rows = items.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), worst.alias("m"))
        left.append(rows.select("lang", "phrase", "a", "m.l", "m.r", "m.score"))
    best = left[0]
    for more in left[1:]:
        best = best.unionByName(more)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    if top is not None:  # the best of parts of each language first: a language can hold a third of all phrases
        parts = shuffle_parts(docs.sparkSession)
        for n in (parts * 4, max(2, int(parts**0.5))):
            part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(n))).orderBy(*order)
            best = best.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("rank")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    best = best.withColumn("rank", rank.cast("bigint"))
    best = best.where(F.col("rank") <= top) if top is not None else best
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), spans AS (
  SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM lists
), grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM spans, (VALUES (1), (2), (3)) t(m) WHERE i + m - 1 <= len(w)
), f AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY ALL HAVING count(*) >= 10
), n AS (
  SELECT lang, count(*) AS n FROM grams WHERE m = 1 GROUP BY lang
), parts AS MATERIALIZED (
  SELECT lang, m, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM f WHERE m > 1)
), cuts AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM parts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM f WHERE m = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM f WHERE m = 3
), most AS (
  SELECT lang, phrase, max(f) AS f FROM inside GROUP BY ALL
), left_over AS (
  SELECT w.* FROM worst w LEFT JOIN most o ON o.lang = w.lang AND o.phrase = w.phrase AND w.m = 2 WHERE o.f IS NULL OR 100 * o.f < 50 * w.a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over
) JOIN n USING (lang) WHERE rank <= 2000
"""
