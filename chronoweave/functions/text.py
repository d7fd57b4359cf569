"""Text columns: tokens, answer normalisation, prompts, snippets, renderings of expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .temporal import MONTHS

# White space as Python's str.split() sees it, the ASCII punctuation, the articles.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]+"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = r"\b(a|an|the)\b"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"^{SPACE}|{SPACE}\z", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def tokens(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def prefix(text: Column, chars: int = 400) -> Column:
    return F.substring(text, 1, chars)


def one_line(text: Column) -> Column:
    return strip(F.translate(text, "\n", " "))


def normalize_answer(text: Column) -> Column:
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return squeeze(F.regexp_replace(bare, ARTICLES, " "))


def strip_prediction(text: Column) -> Column:
    """Without a leading "answer:", quotes around, [n] marks, and all but the first line."""
    t = strip(F.regexp_replace(strip(text), r"(?i)^answer\s*[:\-]\s*", ""))
    t = F.regexp_replace(F.regexp_replace(t, r'^"+|"+$', ""), r"^'+|'+$", "")
    t = strip(F.regexp_replace(strip(t), r"\s*\[\d+\]\s*", " "))
    return strip(F.substring_index(t, "\n", 1))


def snippet(text: Column, width: int = 160) -> Column:
    flat = squeeze(text)
    return F.when(F.length(flat) > width, F.concat(F.rtrim(F.substring(flat, 1, width)), F.lit(" …"))).otherwise(flat)


def prompt(question: Column, passages: Column, system: str) -> Column:
    """Chat messages: the system's, and the user's with numbered passages."""
    lines = F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n")
    user = F.concat(F.lit("Passages:\n"), lines, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def instruct(task: str, query: Column) -> Column:
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), query)


def p_marker(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), "n/a").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def month_name(month: Column, letters: int | None = None) -> Column:
    names = F.array(*[F.lit(m.capitalize()[:letters]) for m in MONTHS])
    return F.get(names, month - 1)


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an md5, which SQL elsewhere can repeat."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def choose(u: Column, options: list) -> Column:
    """The option that u in [0, 1) falls on; of columns only that one is computed."""
    if any(isinstance(o, Column) for o in options):
        at, out = F.floor(u * len(options)), None
        for k, o in enumerate(o if isinstance(o, Column) else F.lit(o) for o in options):
            out = F.when(at == k, o) if out is None else out.when(at == k, o)
        return out
    return F.get(F.array(*[F.lit(o) for o in options]), F.floor(u * len(options)).cast("int"))


def date_to_text(e: Column, u: Column) -> Column:
    year, month, day = F.substring(e, 1, 4), F.substring(e, 6, 2).try_cast("int"), F.substring(e, 9, 2).try_cast("int").cast("string")
    part = F.regexp_extract(e, r"s-(\w+)$", 1)
    return (
        F.when(e.rlike(r"^\d{4}-\d{2}-\d{2}$"), choose(u, [F.concat_ws(" ", day, month_name(month), year), F.concat(day, F.lit(", "), month_name(month, 3), F.lit(", "), year)]))
        .when(e.rlike(r"^\d{4}-\d{2}$"), choose(u, [F.concat(month_name(month, 3), F.lit(", "), year), F.concat_ws(" ", month_name(month), year)]))
        .when(e.rlike(r"^\d{4}$"), e).when(part != "", F.concat(part, F.lit(" "), year, F.lit("s"))).otherwise(F.concat(year, F.lit("s")))
    )


def offset_to_text(family: Column, unit: Column, n: Column, u: Column) -> Column:
    """Of an offset's family, unit letter and number."""
    name = F.when(unit == "D", "day").when(unit == "W", "week").when(unit == "M", "month").otherwise("year")
    size = F.abs(n)
    counted = F.concat(size.cast("string"), F.lit(" "), name, F.when(size == 1, "").otherwise("s"))
    ahead = choose(u, [F.concat(F.lit("in "), counted), F.concat(counted, F.lit(" from now")), F.concat(counted, F.lit(" later"))])
    back = choose(u, [F.concat(counted, F.lit(" ago")), F.concat(counted, F.lit(" earlier")), F.concat(counted, F.lit(" before"))])
    return (
        F.when(family == "OFFSET", F.when(n < 0, back).otherwise(ahead))
        .when(family == "THIS", F.when(size == 1, F.concat(F.lit("this "), name)).otherwise(F.concat(F.lit("these "), counted)))
        .when(family == "NEXT_IMMEDIATE", F.when(size == 1, F.concat(F.lit("next "), name)).otherwise(F.concat(F.lit("the next "), counted)))
        .otherwise(F.when(size == 1, F.concat(F.lit("last "), name)).otherwise(F.concat(F.lit("the last "), counted)))
    )


def reference_to_text(e: Column, u: Column) -> Column:
    return F.when(e == "PRESENT_REF", choose(u, ["now", "currently", "at present"])).when(e == "THIS MO", choose(u, ["this morning", "in the morning"])).otherwise(choose(u, ["tonight", "this evening"]))


def interval_to_text(start: Column, end: Column, u: Column) -> Column:
    return choose(u, [F.concat(F.lit("from "), start, F.lit(" to "), end), F.concat(F.lit("between "), start, F.lit(" and "), end), F.concat(start, F.lit(" - "), end)])
