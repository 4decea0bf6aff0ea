"""Answers of models: typed payloads with range and vocabulary checks, guards, carried rows and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import IntegrityError


def number_field(payload: Column, name: str, low: float, high: float) -> Column:
    """A numeric JSON field within its range, else null: text and truth values are no numbers, nothing is clipped."""
    raw = F.get_json_object(payload, f"$.{name}")
    quoted = F.regexp_extract(payload, rf'"{name}"\s*:\s*(["tf])', 1) != ""
    value = raw.try_cast("double")
    return F.when(~quoted & value.between(low, high), value)


def validate_scores(df: DataFrame, payload: str, fields: dict[str, tuple[float, float]]) -> DataFrame:
    """Each field as a double, and `error`: the first field that is absent or out of range, else null."""
    out = df.withColumns({name: number_field(F.col(payload), name, *ends) for name, ends in fields.items()})
    error = F.lit(None).cast("string")
    for name in reversed(list(fields)):
        error = F.when(F.col(name).isNull(), F.lit(f"{name}: absent or out of range")).otherwise(error)
    return out.withColumn("error", F.when(F.col(payload).isNull(), F.lit("payload: absent")).otherwise(error))


def validate_labels(df: DataFrame, payload: str, field: str, allowed: list[str], detail: str, only_for: str, details: list[str]) -> DataFrame:
    """A closed-vocabulary field and a detail that must be there for one value only; `error` says what is wrong."""
    kind, own = F.get_json_object(payload, f"$.{field}"), F.get_json_object(payload, f"$.{detail}")
    error = (
        F.when(kind.isNull() | ~kind.isin(allowed), F.lit(f"{field}: not in the vocabulary"))
        .when((kind == only_for) & (own.isNull() | ~own.isin(details)), F.lit(f"{detail}: not in the vocabulary"))
        .when((kind != only_for) & own.isNotNull(), F.lit(f"{detail}: only for {only_for}"))
    )
    return df.withColumn("error", error).withColumn(field, F.when(error.isNull(), kind)).withColumn(detail, F.when(error.isNull(), own))


def guard_first(rows: DataFrame, run: list[str], build: str, order: str) -> DataFrame:
    """Rows whose build is the first one seen in their run; others are marked in `rejected`."""
    first = rows.filter(F.col(build).isNotNull()).groupBy(*run).agg(F.min_by(build, order).alias("__first"))
    joined = rows.join(first, run, "left")
    return joined.withColumn("rejected", F.coalesce(F.col(build) != F.col("__first"), F.lit(False))).drop("__first")


def carried(rows: DataFrame, ids: DataFrame, key: str, run: str) -> DataFrame:
    """Rows of an earlier run for the wanted ids, with the run they come from."""
    return rows.join(ids.select(key).distinct(), key, "left_semi").withColumn("carried_from", F.struct(F.lit(run).alias("run"), F.col("attempt").alias("attempt")))


def costs(rows: DataFrame, prices: DataFrame, model: str, prompt: str, answer: str) -> DataFrame:
    """Tokens and cost by model at prices for a million tokens (prompt_price, answer_price); a model without a price stops the query."""
    sums = rows.groupBy(model).agg(F.sum(prompt).alias("prompt_tokens"), F.sum(answer).alias("answer_tokens"))
    sums = sums.join(prices, model, "left")
    unknown = F.raise_error(F.concat(F.lit("no price for "), F.coalesce(F.col(model), F.lit("a null model")))).cast("double")
    sums = sums.withColumn("prompt_price", F.when(F.col("prompt_price").isNull() | F.col("answer_price").isNull(), unknown).otherwise(F.col("prompt_price")))
    return sums.withColumn("cost", (F.col("prompt_tokens") * F.col("prompt_price") + F.col("answer_tokens") * F.col("answer_price")) / 1e6).drop("prompt_price", "answer_price")


def check_resumable(manifest: dict, current: dict, keys: list[str]) -> None:
    """Stop if a run's settings differ from its manifest; all differences are named."""
    bad = {k: (manifest.get(k), current.get(k)) for k in keys if manifest.get(k) != current.get(k)}
    if bad:
        raise IntegrityError(f"the run was begun with other settings: {bad}")


def check_seam(first: DataFrame, second: DataFrame, day: str, seam) -> None:
    """Stop unless the first source ends before `seam` and the second starts on it or later."""
    a, b = first.agg(F.max(day)).first()[0], second.agg(F.min(day)).first()[0]
    if a is not None and a >= seam or b is not None and b < seam:
        raise IntegrityError(f"sources overlap at {seam}: {a}, {b}")
