"""Text functions as column expressions; Python only where a built-in cannot express them."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalise(text: Column, unicode: bool = False) -> Column:
    """White-space runs as one space, trimmed. ASCII white space, or Unicode's on request."""
    pattern = r"(?U)\s+" if unicode else r"[ \t\n\x0B\f\r]+"
    return F.trim(F.regexp_replace(text, pattern, " "))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+"))


def keyword_pattern(terms: list[str], unicode: bool = False) -> str:
    """Whole words or phrases, longest first, any case; a space matches white space. Words and case are ASCII's, or Unicode's on request."""
    ordered = sorted(set(terms), key=lambda t: (-len(t), t))
    return ("(?iU)" if unicode else "(?i)") + r"\b(?:" + "|".join(r"\s+".join(re.escape(w) for w in t.split()) for t in ordered) + r")\b"


def blank(text: Column, exclude: list[str] | None, unicode: bool = False) -> Column:
    """Whole-word matches of the patterns `exclude` as white space."""
    if not exclude:
        return text
    return F.regexp_replace(text, ("(?iU)" if unicode else "(?i)") + r"\b(?:" + "|".join(exclude) + r")\b", " ")


def count_keywords(text: Column, terms: list[str], exclude: list[str] | None = None, unicode: bool = False) -> Column:
    """Occurrences of terms after excluded phrases are blanked."""
    return F.regexp_count(blank(text, exclude, unicode), F.lit(keyword_pattern(terms, unicode)))


def keyword_hits(df: DataFrame, lists: dict[str, list[str]], text: str = "text") -> DataFrame:
    """`<list>_hits` and `<list>` (0/1) for each list, in one pass."""
    counts = {f"{name}_hits": F.coalesce(count_keywords(F.col(text), terms), F.lit(0)) for name, terms in lists.items()}
    return df.withColumns(counts).withColumns({name: (F.col(f"{name}_hits") > 0).cast("int") for name in lists})


def keyword_context(df: DataFrame, key: str, terms: list[str], text: str = "text", context: int = 150) -> DataFrame:
    """(key, start, hit, snippet) of each occurrence: with the text on both sides, cut at `context` characters."""
    pattern = keyword_pattern(terms)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(F.col(text), pattern, -1)
    rows = df.withColumn("__h", hits).withColumn("__b", between).filter(F.size("__h") > 0)
    at = F.explode(F.sequence(F.lit(0), F.size("__h") - 1)).alias("__i")
    rows = rows.select(F.col(key), F.col(text).alias("__t"), "__h", "__b", at)
    before = F.aggregate(F.slice("__b", F.lit(1), F.col("__i") + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice("__h", F.lit(1), F.col("__i")), F.lit(0), lambda a, x: a + F.length(x))
    rows = rows.withColumn("start", before).withColumn("hit", F.get("__h", F.col("__i")))
    low = F.greatest(F.col("start") - context, F.lit(0))
    return rows.select(key, "start", "hit", F.substring(F.col("__t"), low + 1, F.col("start") + F.length("hit") + context - low).alias("snippet"))


# Apostrophes that count as the plain one.
APOSTROPHES = "‘’ʼ`´"


@F.pandas_udf(T.StringType())
def fold(names: pd.Series) -> pd.Series:
    """Upper case without accents; curly apostrophes become plain. No built-in decomposes characters."""
    table = str.maketrans(dict.fromkeys(APOSTROPHES, "'"))

    def one(name):
        if name is None:
            return None
        wide = unicodedata.normalize("NFKD", name.translate(table))
        return "".join(c for c in wide if not unicodedata.combining(c)).upper()

    return names.map(one, na_action="ignore")


def first_json(text: str) -> str | None:
    """The first balanced JSON object in a text, aware of strings and escapes."""
    depth, start, quoted, escaped = 0, None, False, False
    for i, c in enumerate(text):
        if start is not None and quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == "{":
            start, depth = (i if start is None else start), depth + 1
        elif start is not None and c == '"':
            quoted = True
        elif start is not None and c == "}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


@F.pandas_udf(T.StringType())
def extract_json(texts: pd.Series) -> pd.Series:
    """first_json of each text; balanced braces are beyond regular expressions."""
    return texts.map(first_json, na_action="ignore")


def segments(df: DataFrame, key: str, tag: str, text: str = "text") -> DataFrame:
    """(key, place, label, body): the text cut before every line that starts with `tag` (a pattern with one group, the label)."""
    pieces = F.split(F.col(text), rf"(?m)^(?={tag})", -1)
    rows = df.select(key, F.posexplode(pieces).alias("place", "piece")).filter(F.col("piece").rlike(rf"^{tag}"))
    return rows.select(key, "place", F.regexp_extract("piece", rf"^{tag}", 1).alias("label"), normalise(F.regexp_replace("piece", rf"^{tag}", "")).alias("body"))


def cut_and_strip(text: Column, cut_at: list[str], strip: list[str]) -> Column:
    """The text up to the earliest match of `cut_at`, without matches of `strip`, normalised."""
    places = [F.length(F.get(F.split(text, p, 2), F.lit(0))) for p in cut_at]
    head = F.substring(text, F.lit(1), F.least(*places) if len(places) > 1 else places[0]) if places else text
    for p in strip:
        head = F.regexp_replace(head, p, " ")
    return normalise(head, unicode=True)


def stable_id(prefix: str, *columns: str) -> Column:
    """prefix and 16 hex digits of SHA-1 over the columns; null counts as the text None."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns])), 1, 16))


def id_set_digest(df: DataFrame, column: str) -> DataFrame:
    """Order-free digest of a set of ids: count, and the sum and xor of 64-bit hashes (no gathered list)."""
    h = F.xxhash64(column)
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("sum"))



def surname_key(name: Column) -> Column:
    """Upper-case letter tokens of a name without gaps."""
    from ..operators.resolve import name_tokens

    return F.array_join(name_tokens(name), "")


def code_of(name: Column, codes: dict[str, str]) -> Column:
    """The code of a folded name, or null; `codes` has folded names."""
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.try_element_at(table, F.regexp_replace(F.trim(fold(name)), r"\s+", " "))


def clean_record(text: Column, header: str, time_line: str, footers: list[str], page_marks: list[str]) -> Column:
    """The body of a printed record: what comes after `header`, up to the first footer or to a rule line that no time line follows, without page marks.

    All patterns are Java ones, with (?m) where lines matter.
    """
    rule = rf"(?m)^\s*_{{5,}}\s*$(?!\s*{time_line})"
    body = F.regexp_replace(text, rf"(?s)\A.*?{header}", "")
    return cut_and_strip(body, [*footers, rule], [*page_marks, rf"(?m)^\s*_{{5,}}\s*$", time_line])


def keyword_table(spark, lists: dict[str, list[str]]) -> DataFrame:
    """(list, place, term) rows of the keyword lists."""
    return spark.createDataFrame([(name, i, t) for name, terms in lists.items() for i, t in enumerate(terms)], "list string, place int, term string")
