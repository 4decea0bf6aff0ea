"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash_edge

PROFILE = 300
#: Rows of each language, those with the smallest hash of their key, that the profiles are learned from.
TRAIN_ROWS = 1000
UNKNOWN = "und"
BITS = 21


def alphabet() -> np.ndarray:
    """For each code point of the basic plane its lower-case letter, or 0 where it is no letter."""
    table = np.zeros(1 << 16, dtype=np.int64)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def ngrams(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted codes, counts) of the 1- to 3-grams of a whole text's words, with word edges; empty without letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    high = points > 0xFFFF
    own = letters[np.where(high, 0, points)]
    if high.any():
        odd, back = np.unique(points[high], return_inverse=True)
        own[high] = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in odd])[back]
    own = np.concatenate([[0], own, [0]])
    own = own[np.concatenate([[True], (own[1:] != 0) | (own[:-1] != 0)])]
    one = own[own != 0]
    if not len(one):
        return one, one
    two = own[:-1] << BITS | own[1:]
    three = two[:-1] << BITS | own[2:]
    three = three[own[1:-1] != 0]
    codes = np.sort(np.concatenate([one, two | 1 << 62, three]))
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[starts], np.diff(np.append(starts, len(codes)))


def top(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent codes, by falling count, then rising code."""
    return codes[np.argsort(-counts, kind="stable")[:PROFILE]]


class Profiles:
    def __init__(self, ranks: dict[str, list[int]]):
        self.languages = sorted(ranks)
        self.codes = np.unique(np.concatenate([np.array(r, dtype=np.int64) for r in ranks.values()])) if ranks else np.zeros(0, np.int64)
        self.rank = np.full((len(self.codes) + 1, len(self.languages)), PROFILE, dtype=np.int64)
        self.missing = np.zeros((len(self.codes) + 1, len(self.languages)), dtype=bool)
        for j, language in enumerate(self.languages):
            self.rank[np.searchsorted(self.codes, ranks[language]), j] = np.arange(len(ranks[language]))
        self.missing = self.rank == PROFILE

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float]:
        """(language, 1 - distance / largest distance); ties go to the first name, no letter to `und`."""
        codes, counts = ngrams(text, letters) if text else ((), ())
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        own = top(codes, counts)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        at[self.codes[at] != own] = len(self.codes)
        places = np.abs(self.rank[at] - np.arange(len(own))[:, None])
        places[self.missing[at]] = PROFILE
        distance = places.sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], float(1 - distance[best] / (PROFILE * len(own)))


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Profiles:
    """Profiles from whole texts of up to `rows` labelled rows of each language that are not held out.

    Rows without key, text or lang are not learned from. The driver gets PROFILE codes of each language.
    """
    narrow = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    narrow = narrow.select(F.col(key).alias("k"), F.col(lang).cast("string").alias("l"), F.col(text).alias("t"))
    rank = F.xxhash64("k")
    near = F.lit(False)  # rows that may be among the smallest hashes of their language
    sizes = {r["l"]: r["count"] for r in narrow.groupBy("l").count().collect()}
    for language, n in sizes.items():
        near = near | ((F.col("l") == language) & (rank <= F.lit(hash_edge(rows, n))))
    place = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    first = narrow.filter(near).select("l", rank.alias("h")).withColumn("n", place).filter(F.col("n") <= rows).groupBy("l").agg(F.max("h").alias("h"), F.count(F.lit(1)).alias("n")).collect()
    edges, passed = {r["l"]: r["h"] for r in first}, {r["l"]: r["n"] for r in first}
    short = [language for language, n in sizes.items() if passed.get(language, 0) < min(rows, n)]
    if short:  # where keys repeat, too few rows may meet the bound: the smallest hashes of all rows
        hashes = narrow.filter(F.col("l").isin(short)).groupBy("l", rank.alias("h")).agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("l").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        edges |= {r["l"]: r["h"] for r in hashes.withColumn("before", before).filter(F.col("before") < rows).groupBy("l").agg(F.max("h").alias("h")).collect()}
    if not edges:
        return Profiles({})
    chosen = F.lit(False)
    for language, edge in edges.items():
        chosen = chosen | ((F.col("l") == language) & (rank <= F.lit(edge)))

    def count(frames):
        letters, sums = alphabet(), {}
        for frame in frames:
            for language, value in zip(frame["l"], frame["t"], strict=True):
                sums.setdefault(language, []).append(ngrams(value, letters))
        for language, parts in sums.items():
            codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            yield pd.DataFrame({"l": language, "code": codes, "n": np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)})

    counted = narrow.filter(chosen).select("l", "t").mapInPandas(count, "l string, code long, n long").groupBy("l", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("l").orderBy(F.desc("n"), "code")
    found = counted.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= PROFILE).collect()
    ranks: dict[str, list] = {}
    for r in sorted(found, key=lambda r: r["r"]):
        ranks.setdefault(r["l"], []).append(r["code"])
    return Profiles(ranks)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", language: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of `docs` with the columns `language` and `score`, whose names `docs` must not have yet.

    A null text, or one without a letter, is `und` with score 0. Whole texts are read, one at a time.
    """
    at = docs.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{language}` string, `{score}` double"

    def run(batches):
        import pyarrow as pa

        letters = alphabet()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [profiles.predict(t, letters) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*part.schema.names, language, score]
                )

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; a null doc_id is not held out and not learned from."""
    found = predict(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
