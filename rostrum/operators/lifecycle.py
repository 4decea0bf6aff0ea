"""Life of a scoring run: finding runs, manifests and stages, resuming, carrying rows over, forecasts, and the scoring loop.

The models themselves are outside: `score_rows` takes any object with a method `score`.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .checks import IntegrityError, join_checked

STAMP = r"\d{8}T\d{6}Z"


def catalogue(folder: str, suffix: str = "manifest") -> list[tuple[str, str]]:
    """(label, run) of every `<label>_<suffix>_<time>.json` in a local folder, by run then label."""
    pattern = re.compile(rf"(.+)_{re.escape(suffix)}_({STAMP})\.json")
    found = [m.groups() for p in Path(folder).glob("*.json") if (m := pattern.fullmatch(p.name))]
    return sorted(found, key=lambda f: (f[1], f[0]))


def label_of(folder: str, run: str, suffix: str = "manifest") -> str:
    """The one label of a run; none or several is an error."""
    labels = [label for label, r in catalogue(folder, suffix) if r == run]
    if len(labels) != 1:
        raise IntegrityError(f"run {run} has {len(labels)} manifests in {folder}: {labels}")
    return labels[0]


def latest_run(folder: str, suffix: str = "manifest") -> str:
    """The latest run, whatever its label."""
    runs = [r for _, r in catalogue(folder, suffix)]
    if not runs:
        raise IntegrityError(f"no runs in {folder}")
    return max(runs)


def manifest_of(folder: str, run: str, suffix: str = "manifest") -> dict:
    return json.loads((Path(folder) / f"{label_of(folder, run, suffix)}_{suffix}_{run}.json").read_text())


def models_of(folder: str, run: str, default: list[str]) -> list[str]:
    """The models a run was begun with; old manifests without a list mean `default`."""
    return manifest_of(folder, run).get("models") or default


def text_sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def settings(template: str, corpus_sha256: str, model: dict) -> dict:
    """What determines a run's results."""
    return {"prompt_sha256": text_sha256(template), "corpus_sha256": corpus_sha256, "model": model}


def new_manifest(run: str, label: str, own: dict, template: str, seed: int) -> dict:
    """A manifest with the whole prompt and a hash of the settings."""
    return {"run": run, "label": label, "settings": own, "settings_sha256": text_sha256(json.dumps(own, sort_keys=True)), "prompt": template, "seed": seed, "stages": []}


def stage_record(number: int, selection: dict, ids: DataFrame, key: str, pending: int, estimate: dict, started: str) -> dict:
    """An entry of a manifest's stages; the ids are kept as an order-free digest."""
    from ..functions.text import id_set_digest

    digest = id_set_digest(ids, key).first()
    return {"stage": number, "selection": selection, "n_ids": digest["n"], "ids_digest": f"{digest['xor']}:{digest['sum']}", "pending": pending, "estimate": estimate, "started_at": started}


def match_models(old: dict[str, dict], current: dict[str, dict], equivalents: dict[str, dict[str, list]]) -> dict[str, str]:
    """Old model names to current ones with equal settings. `equivalents`: setting to lists of values that count as one. No match is an error."""
    def plain(own: dict) -> dict:
        return {k: next((str(group) for group in equivalents.get(k, {}).values() if v in group), v) for k, v in own.items()}

    out = {}
    for name, own in old.items():
        fits = [c for c, theirs in current.items() if plain(theirs) == plain(own)]
        if len(fits) != 1:
            raise IntegrityError(f"{name} matches {len(fits)} current models: {fits}")
        out[name] = fits[0]
    return out


def check_served(rows: DataFrame, model: str, served: str, expected: dict[str, str]) -> DataFrame:
    """`rows`, or an error if a successful row was served by another model than its own."""
    wanted = F.try_element_at(F.create_map(*[F.lit(x) for kv in expected.items() for x in kv]), F.col(model))
    bad = rows.filter(F.col(served).isNotNull() & ~F.coalesce(F.col(served) == wanted, F.lit(False))).groupBy(model, served).count().limit(10).collect()
    if bad:
        raise IntegrityError(f"served by other models: {[tuple(r) for r in bad]}")
    return rows


def carry_over(old: DataFrame, ids: DataFrame, key: str, model: str, served: str, names: dict[str, str], expected: dict[str, str], run: str) -> DataFrame:
    """Rows of an earlier run that the present one may keep: wanted ids, matched models, served as expected."""
    from .payloads import carried

    renamed = check_served(old, model, served, expected).filter(F.col(model).isin(list(names)))
    renamed = renamed.withColumn(model, F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(model)))
    return carried(renamed, ids, key, run)


def effective_labels(attempts: DataFrame, key: str, label: str, blocks: dict[str, str], order: str, error: str = "error") -> DataFrame:
    """One row for each attempted id: its effective label, the label's block, and whether the attempt succeeded."""
    from .windows import effective_rows

    rows = effective_rows(attempts.withColumn("label_ok", F.col(error).isNull()), [key], "label_ok", order)
    block = F.try_element_at(F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv]), F.col(label))
    return rows.select(key, F.when(F.col("label_ok"), F.col(label)).alias(label), F.when(F.col("label_ok"), block).alias("block"), "label_ok", error)


def scored_run(ensemble: DataFrame, models: DataFrame, corpus: DataFrame, crosswalk: DataFrame, labels: DataFrame | None, key: str, unit: list[str], scores: list[str]) -> DataFrame:
    """The analysis table of a run: ensemble and model scores, corpus and crosswalk columns, labels, `procedural` and `member_key`.

    `models`: (key, model, scores). A scored id that the corpus lacks stops. procedural: some
    model scored the row, and every score there is 0.
    """
    value = [F.coalesce(F.col(s), F.lit(0.0)) != 0 for s in scores]
    some, any_score = value[0], F.col(scores[0]).isNotNull()
    for v, s in zip(value[1:], scores[1:], strict=True):
        some, any_score = some | v, any_score | F.col(s).isNotNull()
    flags = models.groupBy(key).agg((F.max(any_score.cast("int")) == 1).alias("__any"), (F.max(some.cast("int")) == 1).alias("__some"), F.count(F.lit(1)).alias("n_model_rows"))
    rows = join_checked(ensemble, corpus, [key], "left", one_to_one=True, complete=True)
    rows = rows.join(flags, key, "left").join(crosswalk, unit, "left")
    rows = rows.withColumn("procedural", F.coalesce(F.col("__any") & ~F.col("__some"), F.lit(False))).drop("__any", "__some")
    rows = rows.withColumn("member_key", F.coalesce(F.concat(F.lit("icpsr:"), F.col("icpsr").cast("string")), F.concat_ws(":", "source", "member_id")))
    return rows if labels is None else rows.join(labels, key, "left")


def attach(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Left join, many to one: the table's keys must be unique; null keys match nothing."""
    return join_checked(rows, table, on, "left")


def substantive(rows: DataFrame, label: str, outside: list[str]) -> DataFrame:
    """Labelled rows whose label is not in the list; unlabelled ones go."""
    return rows.filter(F.col(label).isNotNull() & ~F.col(label).isin(outside))


def validation_rows(rows: DataFrame, rule: str, score: str, label: str, outside: list[str], flag: str = "in_validation") -> DataFrame:
    """Rows of the validation: none (all), zero_score (without scores of 0), or labels (substantive). Another rule is an error."""
    own = rows.filter(F.coalesce(F.col(flag), F.lit(False)) & F.col(score).isNotNull())
    if rule == "none":
        return own
    if rule == "zero_score":
        return own.filter(F.col(score) != 0)
    if rule == "labels":
        return substantive(own, label, outside)
    raise ValueError(f"unknown rule {rule}")


def days_of_january(day: Column, years: list[int], first: int = 3, last: int = 19) -> Column:
    """Whether a day lies between two days of January in one of the years."""
    return F.year(day).isin(years) & (F.month(day) == 1) & F.dayofmonth(day).between(first, last)


def render(template: str, text: Column, mark: str = "{speech_text}") -> Column:
    """The template with the text in place of the mark, as it is."""
    head, gap, tail = template.partition(mark)
    if not gap:
        raise ValueError(f"the template lacks {mark}")
    return F.concat(F.lit(head), text, F.lit(tail.replace(mark, "")))


def forecast(ids: DataFrame, tokens: str, models: list[str], prices: DataFrame, answer_tokens: float) -> DataFrame:
    """Calls, tokens and cost by model if each id is asked once; an unknown model stops."""
    from .payloads import costs

    asked = ids.select(F.col(tokens).alias("prompt"), F.lit(float(answer_tokens)).alias("answer")).withColumn("model", F.explode(F.array(*map(F.lit, models))))
    return costs(asked, prices, "model", "prompt", "answer").join(asked.groupBy("model").agg(F.count(F.lit(1)).alias("calls")), "model")


def token_estimate(text: Column) -> Column:
    """About four characters a token; an estimate only."""
    return F.ceil(F.length(text) / 4).cast("long")


def score_rows(rows: DataFrame, make_scorer: Callable[[], object], key: str, prompt: str, model: str, stage: int, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """One attempt row for each input row: (key, model, answer, error, tries, stage). Rows are never lost: a failure is a row with `error`.

    `make_scorer()` is called once in each task; its `score(prompt)` is tried again after a growing pause.
    """
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for frame in frames:
            out = []
            for k, text in zip(frame[key], frame[prompt], strict=True):
                answer = error = None
                for attempt in range(1, tries + 1):
                    try:
                        answer, error = scorer.score(text), None
                        break
                    except Exception as e:  # a model's failure of any kind is a result
                        error = f"{type(e).__name__}: {e}"
                        if attempt < tries:
                            time.sleep(pause * 2 ** (attempt - 1))
                out.append((k, model, answer, error, attempt, stage))
            yield pd.DataFrame(out, columns=[key, "model", "answer", "error", "tries", "stage"])

    return rows.select(key, prompt).mapInPandas(run, f"`{key}` {kind}, model string, answer string, error string, tries int, stage int")


def selected_ids(spark: SparkSession, selection: dict, corpus: DataFrame, key: str, scores: str | None = None) -> DataFrame:
    """Ids of a selection: from_run (a run's ids), ids_file, or a stratified sample (strata, limit, seed) of the corpus; `limit` cuts in seeded order."""
    from ..sources.readers import ids_from_text
    from .sampling import draw_key, quota_sample

    if "from_run" in selection:
        ids = spark.read.json(f"{scores}/{selection['from_run']}").select(key).distinct()
    elif "ids_file" in selection:
        ids = ids_from_text(spark, selection["ids_file"]).withColumnRenamed("id", key).distinct()
    else:
        return quota_sample(corpus, selection["strata"], key, selection["limit"], selection["seed"]).select(key)
    if selection.get("limit"):
        ids = ids.orderBy(draw_key(selection.get("seed", 0), key), key).limit(selection["limit"])
    return ids
