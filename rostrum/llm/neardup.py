"""MinHash near-duplicate detection with odd sketches.

MinHash values of each document's shingle set are cut into bands that propose pairs, and folded
into an odd sketch: a bitmap in which each sample flips one bit. The population count of two
sketches' XOR estimates a high similarity closely; pairs far below the threshold are dropped by it
and the rest are confirmed on full sets.

Links are needed only as far as they join components. So a bucket's members first meet its first
node. Where some of three or more stay apart, pairs between different parts are tested: as rows in
small buckets, and by blocks of members in larger ones, so that a large group of near copies makes
no row for each pair. No link between different parts is lost.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, drop_scratch, ranked, salted_join, saved
from .shingles import Hasher, mix, stream

SKETCH_BITS = 1024
SKETCH_SLACK = 0.08
MISS = 1e-6
SMALL_BUCKET = 6
BLOCK_NODES = 512
BLOCK_BYTES = 4 << 20
COLUMNS = 4096
#: Rows of 8-byte keys that a broadcast of candidate documents may have; more are joined by shuffle.
BROADCAST_ROWS = 4_000_000


def banding(similarity: float) -> tuple[int, int]:
    """(bands, rows of a band): as many rows as 192 samples allow while a pair at the threshold is missed with at most MISS."""
    best = (192, 1)
    for rows in range(1, 13):
        chance = similarity**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(MISS) / math.log(1 - chance))
        if bands * rows <= 192:
            best = (bands, rows)
    return best


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n, same (digest of the set), bands and sketch of every row; the last three are null for an empty set."""
    def run(batches):
        import pyarrow as pa

        hasher, k = Hasher(width), bands * rows
        a, b = stream(k, 21) | np.uint64(1), stream(k, 22)
        place, band = stream(k, 23), stream(rows, 24) | np.uint64(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = hasher.sets(part.column(1).to_pylist())
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    codes = np.concatenate([sets[i] for i in full])
                    starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
                    sample = np.stack([np.minimum.reduceat(codes * a[j] + b[j], starts) for j in range(k)], axis=1)
                    key = mix((sample.reshape(len(full), bands, rows) * band).sum(axis=2, dtype=np.uint64) + stream(bands, 25))
                    bit = (mix(sample + place) >> np.uint64(54)).astype(np.int64)  # SKETCH_BITS is 2^10
                    flips = np.zeros((len(full), SKETCH_BITS), np.uint8)
                    np.add.at(flips, (np.arange(len(full))[:, None], bit), 1)
                    sketch = np.packbits(flips & 1, axis=1).view("<i8")
                where = {i: r for r, i in enumerate(full)}
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([key[where[i]].view(np.int64) if i in where else None for i in range(len(sets))], pa.list_(pa.int64())),
                        pa.array([sketch[where[i]] if i in where else None for i in range(len(sets))], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "same", "bands", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, same binary, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, codes) of the documents in `wanted` (node, first, same): their whole sets as sorted 64-bit numbers."""
    small = wanted.count() <= BROADCAST_ROWS
    own = wanted.select("node", "first", "same")
    own = F.broadcast(own) if small else own
    rows = docs.join(own, docs["doc_id"].eqNullSafe(F.col("first"))).select("node", "same", "text")

    def run(batches):
        import pyarrow as pa

        hasher = Hasher(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                codes = [s.tobytes() for s in hasher.sets(part.column(2).to_pylist())]
                keep = [hashlib.blake2b(c, digest_size=16).digest() == s for c, s in zip(codes, part.column(1).to_pylist(), strict=True)]
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(codes, pa.binary())], ["node", "codes"])
                yield out.filter(pa.array(keep))

    return rows.mapInArrow(run, "node long, codes binary")


def sketch_similarity(a: Column, b: Column, samples: int) -> Column:
    """The similarity that two odd sketches suggest; null where they differ too much to tell."""
    odd = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    left = 1 - 2 * odd / F.lit(SKETCH_BITS)
    return F.when(left > 0, 1 + F.log(left) * (SKETCH_BITS / (4 * samples)))


def confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, samples: int) -> DataFrame:
    """Those of `pairs` (a, b) with 100 * intersection >= percent * union, first by sketch, then on full sets."""
    share = percent / 100
    # six standard deviations of the sample's error, and the sketch's own
    floor = share - 6 * math.sqrt(share * (1 - share) / samples) - SKETCH_SLACK
    left = sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = pairs.join(left, "a").join(right, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    near = near.filter(sketch_similarity(F.col("sa"), F.col("sb"), samples) >= floor).select("a", "b")
    one = near.join(sets.select(F.col("node").alias("b"), F.col("codes").alias("cb")), "b")
    both = one.join(sets.select(F.col("node").alias("a"), F.col("codes").alias("ca")), "a").select("a", "b", "ca", "cb")

    def run(batches):
        for batch in batches:
            keep = []
            last, x = None, None
            for at in range(batch.num_rows):
                a = batch.column(0)[at].as_py()
                if a != last:
                    last, x = a, np.frombuffer(batch.column(2)[at].as_py(), np.uint64)
                y = np.frombuffer(batch.column(3)[at].as_py(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[place] == small).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            import pyarrow as pa

            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def joined_parts(found: DataFrame) -> DataFrame:
    """(node, part): the smallest node of those that a node links with, itself included, then that one's own.

    Nodes of one part are linked; linked nodes may still have different parts, which costs a test
    more but loses nothing. Whole components are made once, at the end.
    """
    both = found.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(found.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = saved(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("part")), "parts")
    ahead = least.select(F.col("node").alias("part"), F.col("part").alias("next"))
    return saved(least.join(ahead, "part", "left").select("node", F.coalesce("next", "part").alias("part")), "parts")


def units_of(live: DataFrame) -> DataFrame:
    """(unit, node, part, m): the sets of nodes within which all pairs are still to be tested.

    Buckets that share nodes overlap almost wholly where many near copies meet, so they are taken
    together, if testing all pairs of the whole costs no more than testing those of each bucket;
    otherwise each bucket is a unit.
    """
    firsts = live.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("m"))
    groups = components(live.join(firsts, "key").select(F.col("node").alias("a"), F.col("head").alias("b")), "unit-components")
    homes = saved(firsts.join(groups, firsts["head"] == groups["node"]).select("key", "component", "m"), "unit-homes")
    costs = homes.groupBy("component").agg(F.sum(F.col("m") * F.col("m")).alias("cost"))
    wide = groups.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
    kinds = costs.join(wide, "component").select("component", "nodes", (F.col("nodes") * F.col("nodes") <= F.col("cost")).alias("together"))
    rows = salted_join(live.join(homes, "key"), kinds, "component", "node")
    whole = F.col("together")
    return rows.select(
        whole.alias("whole"), F.when(whole, F.col("component")).otherwise(F.col("key")).alias("unit"), "node", "part", F.when(whole, F.col("nodes")).otherwise(F.col("m")).alias("m")
    ).distinct()


def block_links(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different parts of each unit, enough to join all that links join.

    A unit's nodes are dealt to blocks of bounded rows and bytes, and each pair of blocks is one
    group: its intersections are products of 0/1 matrices. No pair becomes a row unless it is a
    link that joins two parts.
    """
    bulk = units.join(sets.select("node", "codes"), "node")
    size = bulk.groupBy("whole", "unit").agg(F.sum(F.length("codes")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_NODES), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    dealt = bulk.join(size, ["whole", "unit"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    pairs = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with"))

    def compare(frame):
        import pandas as pd

        frame = frame.sort_values("node")
        node, part, block = frame["node"].to_numpy(), frame["part"].to_numpy(), frame["block"].to_numpy()
        codes = [np.frombuffer(c, np.uint64) for c in frame["codes"]]
        own = np.array([len(c) for c in codes])
        left = np.flatnonzero(block == frame["low"].iloc[0])
        right = np.flatnonzero(block == frame["high"].iloc[0])
        flat, column = np.unique(np.concatenate(codes), return_inverse=True)
        row = np.repeat(np.arange(len(codes)), own)
        common = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(column, kind="stable")
        for at in range(0, len(flat), COLUMNS):
            some = order[np.searchsorted(column[order], at) : np.searchsorted(column[order], at + COLUMNS)]
            bits = np.zeros((len(codes), min(COLUMNS, len(flat) - at)), np.float32)
            bits[row[some], column[some] - at] = 1
            common += bits[left] @ bits[right].T
        union = own[left][:, None] + own[right][None, :] - common
        linked = (100.0 * common.astype(np.float64) >= percent * union) & (part[left][:, None] != part[right][None, :])
        i, j = np.nonzero(linked)
        i, j = left[i], right[j]
        # one link for each pair of parts
        ends = np.stack([np.minimum(part[i], part[j]), np.maximum(part[i], part[j])], axis=1)
        _, first = np.unique(ends, axis=0, return_index=True)
        return pd.DataFrame({"a": np.minimum(node[i], node[j])[first], "b": np.maximum(node[i], node[j])[first]})

    parts = max(1, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = ["whole", "unit", "low", "high"]
    return pairs.select(*columns, "node", "part", "block", "codes").repartition(parts, *columns).groupBy(*columns).applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs` (doc_id, text).

    Documents link where 100 * intersection >= percent * union of their `width`-word shingle sets;
    component_id is the smallest doc_id that links reach. Equal sets are one node. A text without
    words, or null, has an empty set and stays alone. A null doc_id joins groups but never names
    one that has another; kept says whether doc_id is component_id (null counts as equal to null),
    so repeated rows are kept or not alike. Other columns are left out.
    """
    bands, rows = banding(percent / 100)
    samples = bands * rows
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = saved(signatures(docs, width, bands, rows), "signatures")
    named = sig.filter("n > 0").groupBy("same").agg(F.min("doc_id").alias("first"))
    nodes = ranked(named, [F.asc_nulls_last("first"), F.asc("same")], "node", "nodes")
    own = sig.join(nodes, (sig["same"] == nodes["same"]) & sig["doc_id"].eqNullSafe(nodes["first"])).select("node", sig["n"], sig["same"], "first", "bands", "sketch")

    keyed = own.select("node", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("key"), "node").distinct()
    keyed = saved(keyed, "bands")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key")
    buckets = saved(keyed.join(shared, "key"), "buckets")
    drop_scratch(keyed)
    candidates = buckets.select("node").distinct()
    sketches = saved(own.join(candidates, "node").select("node", "n", "same", "first", "sketch").dropDuplicates(["node"]), "sketches")
    sets = saved(full_sets(docs, sketches, width).dropDuplicates(["node"]), "full-sets")

    # each bucket's members meet its first node
    heads = buckets.groupBy("key").agg(F.min("node").alias("hub"))
    pairs = buckets.join(heads, "key").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = saved(confirmed(pairs, sketches, sets, percent, samples), "links")
    parts = joined_parts(links)
    # what is left: pairs of different parts in buckets of three or more
    members = buckets.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    open_keys = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("part").alias("p"), F.max("part").alias("q")).filter("m > 2 and p <> q").select("key", "m")
    live = saved(members.join(open_keys, "key").select("key", "node", "part", "m"), "open-members")
    few = live.filter(F.col("m") <= SMALL_BUCKET)
    other = few.select("key", F.col("node").alias("other"), F.col("part").alias("other_part"))
    pairs = few.join(other, "key").filter("part <> other_part and node < other").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    more = saved(confirmed(pairs, sketches, sets, percent, samples), "links")
    units = saved(units_of(live.filter(F.col("m") > SMALL_BUCKET).drop("m")), "units")
    most = saved(block_links(units, sets, percent), "links")
    for done in (buckets, sketches, sets, live, units):
        drop_scratch(done)
    parts = components(links.unionByName(more).unionByName(most)).withColumnRenamed("component", "part")
    for done in (links, more, most):
        drop_scratch(done)

    named = nodes.select("same", "first", "node")
    named = named.join(parts, "node", "left").withColumn("component", F.coalesce("part", "node")).drop("part")
    tops = parts.select(F.col("part").alias("component")).distinct()
    heads = nodes.select(F.col("node").alias("component"), F.col("first").alias("head")).join(tops, "component")
    # a component may hold most nodes; nodes that link with none are their own head
    homes = salted_join(named, heads, "component", "node", "left").select(F.col("same").alias("home"), F.when(F.col("component") == F.col("node"), F.col("first")).otherwise(F.col("head")).alias("head"))
    out = sig.select("doc_id", F.col("n").alias("n_shingles"), "same").join(homes, F.col("same") == F.col("home"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("head")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
