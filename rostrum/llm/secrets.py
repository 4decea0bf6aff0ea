"""Secret scan: fixed rules, and character Markov models compared by log-likelihood ratio.

Only DataFrame functions run on the main path. Two first-order Markov chains over ASCII characters
are fitted: one on random strings, one on ordinary identifiers. A run of token characters counts
as a secret if its mean log-likelihood ratio a transition exceeds a threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_edge

# The base rules, in the order in which kinds are listed. The shorter form of the
# last two finds the same spans, as those rules take maximal runs.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORD = r"(?i)passw(?:or)?d|secret|token|api_?key"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN_LEAST = 8

RUN = r"[A-Za-z0-9+/_=-]{20,}"
SAMPLE_DOCUMENTS = 2000
RANDOM_STRINGS = 3000
SMOOTHING = 0.5
PRIOR = 5.0
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
THRESHOLD = 3.0


def found(text: Column, pattern: str) -> Column:
    """array<struct<start,end,match>> of the leftmost non-overlapping matches, in code points.

    split() gives what lies between the matches that regexp_extract_all() gives, so running
    lengths of both are the places.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.transform(between, F.length).alias("gap"), matches.alias("match"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("spans"))

    def step(state, pair):
        start = state["at"] + pair["gap"]
        end = start + F.length(F.coalesce(pair["match"], F.lit("")))
        span = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"))
        more = F.when(pair["match"].isNull(), state["spans"]).otherwise(F.concat(state["spans"], F.array(span)))
        return F.struct(end.alias("at"), more.alias("spans"))

    return F.aggregate(pairs, empty, step, lambda s: s["spans"])


NO_MATCHES = "array<struct<start:int,end:int,match:string>>"


def rule(text: Column, present: Column, pattern: str) -> Column:
    """found() where the cheap test `present` says that there may be a match."""
    return F.when(present, found(text, pattern)).otherwise(F.array().cast(NO_MATCHES))


def samples(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Labelled strings (random boolean, string) to train on.

    Random: RANDOM_STRINGS digests written in hex, base64, its URL form and capitals. Ordinary:
    token runs outside all base spans in the SAMPLE_DOCUMENTS rows with the smallest hash of key,
    but for long ones that mix digits and letters.
    """
    spark = docs.sparkSession
    rank = F.xxhash64(key)
    # the one bound: so many rows train the ordinary model, whatever the size of the table
    near = docs.select(rank.alias("h")).filter(F.col("h") <= F.lit(hash_edge(SAMPLE_DOCUMENTS, docs.count())))
    edge = near.orderBy("h").limit(SAMPLE_DOCUMENTS).agg(F.max("h")).first()[0]
    chosen = docs.filter(rank <= F.lit(edge if edge is not None else 0)).select(F.coalesce(text, F.lit("")).alias("t"))
    for pattern in (ASSIGN, ACCESS, HEX):
        chosen = chosen.select(F.regexp_replace("t", pattern, " ").alias("t"))
    ordinary = chosen.select(F.lit(False).alias("random"), F.explode(F.regexp_extract_all("t", F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("s"))
    ordinary = ordinary.filter(~(F.col("s").rlike(RUN) & F.col("s").rlike("[0-9]") & F.col("s").rlike("[A-Za-z]")))
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.base64(F.unhex(digest))
    forms = [digest, F.substring(digest, 1, 40), base64, F.translate(base64, "+/=", "-_"), F.upper(F.translate(base64, "+/=", "aZ7"))]
    made = spark.range(RANDOM_STRINGS).select(F.element_at(F.array(*forms), (F.col("id") % len(forms) + 1).cast("int")).alias("s"))
    return ordinary.unionByName(made.select(F.lit(True).alias("random"), "s"))


def fit(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio of each transition (random over ordinary) at 128 * first + second code.

    The driver gets a row for each class and pair of ALPHABET, whatever the input.
    """
    place = F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("i")
    pairs = labelled.filter(F.length("s") > 1).select("random", "s", place).select("random", F.expr("substring(s, i, 2)").alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    single = {c: {b: SMOOTHING + sum(counts.get((c, a + b), 0) for a in ALPHABET) for b in ALPHABET} for c in (False, True)}
    size = {c: sum(single[c].values()) for c in single}
    table = [0.0] * (128 * 128)
    for a in ALPHABET:
        total = {c: sum(counts.get((c, a + b), 0) for b in ALPHABET) + PRIOR for c in (False, True)}
        for b in ALPHABET:
            # a character after one seldom seen falls back on how common it is at all
            chance = {c: (counts.get((c, a + b), 0) + PRIOR * single[c][b] / size[c]) / total[c] for c in (False, True)}
            table[128 * ord(a) + ord(b)] = round(math.log(chance[True] / chance[False]), 4)
    return table


def ratio(string: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio over the transitions of an ASCII string of two or more characters."""
    values = F.split(F.lit(" ".join(map(str, table))), " ").cast("array<double>")  # one literal after constant folding
    codes = F.transform(F.split(string, ""), F.ascii)
    steps = F.transform(F.sequence(F.lit(1), F.length(string) - 1), lambda i: F.get(values, F.element_at(codes, i) * 128 + F.element_at(codes, i + 1)))
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / (F.length(string) - 1)


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """All rows with column `secrets`: array<struct<start, kind, end>> in span order (kind: place in KINDS).

    Base spans are all kept; a Markov span is added where it overlaps none of them. Null text is
    empty; repeated rows are kept. The columns of `docs` must not be named secrets.
    """
    table = fit(samples(docs, text, key))
    t = F.coalesce(F.col(text), F.lit(""))
    value = lambda s: F.regexp_extract(s["match"], ASSIGN, 2)
    kinds = [
        F.filter(rule(t, t.rlike(ASSIGN_WORD), ASSIGN), lambda s: F.length(value(s)) >= ASSIGN_LEAST),
        rule(t, t.contains("AKIA"), ACCESS),
        rule(t, t.rlike(HEX), HEX),
    ]
    of = lambda no: lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind"), s["end"].alias("end"))
    base = F.concat(*[F.transform(c, of(no)) for no, c in enumerate(kinds)])
    likely = F.filter(rule(t, t.rlike(RUN), RUN), lambda s: ratio(s["match"], table) > threshold)
    with_base = docs.withColumns({"__base": base, "__likely": likely})
    free = F.filter("__likely", lambda s: ~F.exists("__base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return with_base.withColumn("secrets", F.array_sort(F.concat("__base", F.transform(free, of(len(KINDS) - 1))))).drop("__base", "__likely")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_digest(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row; other columns are left out."""
    rows = scan_secrets(docs.select("doc_id", "text"), threshold=threshold)
    count = lambda no: F.size(F.filter("secrets", lambda s: s["kind"] == no)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] < len(KINDS) - 1)
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))
