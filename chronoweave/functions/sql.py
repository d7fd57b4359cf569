"""The main functions for SQL: register(spark) makes them temporary functions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

_MU, _VAR = "(({0}a + {0}b + 1) / 2D)", "(({0}b - {0}a + 1) * ({0}b - {0}a + 1) / 12D)"
_KL = "0.5D * ln({vd} / {vq}) + ({vq} + ({mq} - {md}) * ({mq} - {md})) / (2D * {vd}) - 0.5D".format(vd=_VAR.format("d"), vq=_VAR.format("q"), mq=_MU.format("q"), md=_MU.format("d"))
_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, x) -> s + x)"

FUNCTIONS = {
    "day_index(d DATE) RETURNS INT": "datediff(d, DATE'1000-01-01')",
    "temporal_kl(qa INT, qb INT, da INT, db INT) RETURNS DOUBLE": _KL,
    "temporal_similarity(qa INT, qb INT, da INT, db INT) RETURNS DOUBLE": f"1D / (1D + {_KL})",
    "cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": f"try_divide({_DOT.format('a', 'b')}, sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')}))",
    "year_tokens(t STRING) RETURNS ARRAY<INT>": r"array_sort(array_distinct(transform(regexp_extract_all(t, r'\b(1[0-9]{3}|20[0-9]{2})\b', 1), y -> cast(y AS INT))))",
    "squad_normalize(t STRING) RETURNS STRING": r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(t), r'\p{Punct}', ''), r'\b(a|an|the)\b', ' '), r'\s+', ' '))""",
}


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
