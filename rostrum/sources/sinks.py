"""Sinks: all-or-nothing writes, append logs, write-once tables and small JSON files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame


def write_once(df: DataFrame, path: str) -> None:
    """Parquet that must not exist yet; Spark's committer leaves all or nothing."""
    df.write.mode("errorifexists").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Write beside the target, then swap. The old table is set aside until the new one is in place.

    A run that fails while it writes leaves the old table as it was; one that stops within the swap
    leaves it at <path>.old, from where the next call puts it back first.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(f"{path}.new"), jvm.org.apache.hadoop.fs.Path(path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    fs = old.getFileSystem(conf)
    if fs.exists(aside):
        if fs.exists(old):
            fs.delete(aside, True)
        elif not fs.rename(aside, old):
            raise OSError(f"could not put {aside} back")
    fs.delete(new, True)
    df.write.parquet(f"{path}.new")
    if fs.exists(old) and not fs.rename(old, aside):
        raise OSError(f"could not set {old} aside")
    if not fs.rename(new, old):
        raise OSError(f"could not rename {new} to {old}; the old table is at {aside}")
    fs.delete(aside, True)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def save_table(df: DataFrame, path: str, key: list[str]) -> str:
    """Write-once result: `new`, or `same` if a table there agrees within tolerance; else an error before any write."""
    from ..operators.checks import IntegrityError, tables_differ

    spark = df.sparkSession
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        write_once(df, path)
        return "new"
    bad = tables_differ(spark.read.parquet(path), df, key).limit(10).collect()
    if bad:
        raise IntegrityError(f"{path} differs at {[tuple(r) for r in bad]}")
    return "same"


def write_stats(stats: dict, path: str) -> None:
    """Statistics of a build (a few numbers) as indented JSON."""
    Path(path).write_text(json.dumps(stats, indent=2, sort_keys=True, default=str) + "\n")
