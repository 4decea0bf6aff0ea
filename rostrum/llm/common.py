"""Shared helpers: scratch tables in the cluster's shared folder, file access, components, ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or the context's own checkpoint folder.

    Where neither is set, a local session (tests) gets a temporary one; on a cluster, whose machines
    do not share such a folder, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        used = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not used.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = used.get() if used.isDefined() else "file://" + tempfile.mkdtemp(prefix="rostrum-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete a scratch table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch files that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or local path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


class AtomicFile:
    """Writes beside the target and renames at the end, so that a retried or duplicate task leaves one whole file."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        folder, _, name = self.path.rpartition("/")
        self.fs.create_dir(folder, recursive=True)
        self.temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)

    def __enter__(self):
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.temporary, self.path)
        else:
            self.fs.delete_file(self.temporary)


def read_bytes(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def hash_edge(rows: int, total: int) -> int:
    """A bound on 64-bit hashes that about twice `rows` of `total` rows meet: all of them where they are few.

    Filtering by it first keeps a sample by smallest hash from gathering `rows` of each partition.
    """
    if total <= 4 * rows + 100:
        return (1 << 63) - 1
    return -(1 << 63) + (1 << 64) * (2 * rows + 50) // total


def salted_join(rows: DataFrame, table: DataFrame, key: str, salt: str, how: str = "inner", pieces: int = 16) -> DataFrame:
    """`rows` joined with `table`, which has one short row for each `key`, where one key may have most rows.

    Each row of `table` is repeated `pieces` times, and rows of a key are dealt by the hash of `salt`.
    """
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(pieces)).cast("int"))
    spread = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    return dealt.join(spread, [key, "__salt"], how).drop("__salt")


def ranked(df: DataFrame, keys: list, rank: str, name: str, within: str | None = None) -> DataFrame:
    """`df` range-sorted by `keys` with a gapless 0-based `rank`, written to the shared folder.

    No window runs over the whole table: rows get their place within a sorted partition, and the
    partitions' row counts (one row for each partition, and value of `within`) give the offsets.
    `within` must be the first sort key; ranks then start anew for each of its values.
    """
    spark = df.sparkSession
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = (
        df.repartitionByRange(partitions, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("__at", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__at", 33).cast("int"))
        .withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    placed = saved(placed, name)
    by = ["__part"] + ([within] if within else [])
    counts = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first")).collect()
    offsets, at = [], {}
    for r in sorted(counts, key=lambda r: r["__part"]):
        key = r[within] if within else None
        offsets.append((r["__part"], key, at.get(key, 0) - r["first"]))
        at[key] = at.get(key, 0) + r["n"]
    kind = dict(df.dtypes)[within] if within else "int"
    table = spark.createDataFrame(offsets, f"__part int, __key {kind}, __offset long")
    on = placed["__part"] == table["__part"]
    if within:
        on = on & placed[within].eqNullSafe(table["__key"])
    return placed.join(F.broadcast(table), on).select(
        *[placed[c] for c in df.columns], (placed["__at"] + table["__offset"]).alias(rank)
    )


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of an undirected graph given as long columns a and b.

    Alternating large-star and small-star rounds; component is the smallest node. Only minima are
    gathered for a node, never its list of neighbours, and each round is written to the shared
    folder. Null ends and loops are ignored; nodes without edges are absent.
    """
    edges = edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    now = saved(edges.distinct(), name)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = saved(large, name)
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(small_least.select("u", F.col("m").alias("v")))
        following = saved(small.filter("u <> v").distinct(), name)
        # done once every node has one parent and no parent has one: all are stars
        roots = following.select(F.col("v").alias("u"), F.lit(True).alias("root")).distinct()
        bad = following.select("u", F.lit(False).alias("root")).unionByName(roots).groupBy("u").count().filter("count > 1").limit(1).count()
        drop_scratch(now)
        drop_scratch(large)
        now = following
        if not bad:
            break
    node = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    root = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return node.unionByName(root)
