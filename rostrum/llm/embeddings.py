"""Embedding near-duplicates: a robust-pruned flat graph built on overlapping cluster shards.

Each vector belongs to the cells of its OVERLAP nearest centres (fitted on a bounded sample), so
most vectors that link share a cell. Each cell builds a robust-pruned graph; the adjacency lists
of all cells are united; in each cell a greedy search from its medoids and from the query's own
node finds every vector's surroundings, then expands over all vectors in range. A brute-force audit
of some vectors of each cell widens the search until it finds RECALL of their links. An exact check
follows: double-precision cosines within each cell, and of vectors that share no cell all with all,
in blocks, where only what the angles to a block's centre rule out is left out. So every link
counts once, and `recall` tells what share of them the search alone finds.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import AtomicFile, components, drop_scratch, hash_edge, read_bytes, saved, scratch

SAMPLE_ROWS = 20_000  # rows that centres are fitted on, those with the smallest hash
CELL = 1000  # vectors for each centre
OVERLAP = 5  # cells of each vector
LARGEST = 12_000  # members of a cell, with its overlap, above which it gets more centres
REFINEMENTS = 4
DEGREE = 24
CANDIDATES = 64
BACK = 4  # edges of each node that lead back to it
ALPHA = 1.2
BEAM = 32
MEDOIDS = 4
QUERIES = 256
WIDEST = 256
AUDIT = 64
RECALL = 0.99
PAIRS = 100_000
BLOCK = 2048  # vectors of one nearest centre that are compared at once with those of another
RUN = 16  # blocks that a row of work compares with one


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centres_of(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k-means centres of unit rows (fewer where they coincide)."""
    pick = np.random.default_rng(seed).permutation(len(x))
    centres = x[pick[: max(1, min(k, len(x)))]]
    for _ in range(8):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
    return np.unique(centres, axis=0)


def cells_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The OVERLAP nearest centres of each row, by rising number."""
    k = min(OVERLAP, len(centres))
    out = np.empty((len(x), k), np.int32)
    for at in range(0, len(x), 1024):
        near = x[at : at + 1024] @ centres.T
        out[at : at + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return np.sort(out, axis=1)


def first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that both rows hold."""
    both = (a[:, :, None] == b[:, None, :]).any(axis=2)
    return np.where(both, a, np.iinfo(np.int32).max).min(axis=1)


def prune(x: np.ndarray, node: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Robust pruning: each node's neighbours (-1: none) out of its candidates, which lie nearest first.

    A candidate falls out once a kept neighbour is nearer to it than the node is, by factor ALPHA.
    """
    out = np.full((len(node), DEGREE), -1, np.int64)
    c = np.maximum(candidates, 0)
    to_node = 1 - np.einsum("nd,ncd->nc", x[node], x[c])
    between = 1 - np.einsum("nad,nbd->nab", x[c], x[c])
    live = (candidates >= 0) & (candidates != node[:, None])
    rows = np.arange(len(node))
    for step in range(DEGREE):
        first = np.where(live.any(axis=1), live.argmax(axis=1), -1)
        if (first < 0).all():
            break
        has = first >= 0
        out[has, step] = candidates[rows[has], first[has]]
        live[rows[has], first[has]] = False
        live[has] &= ALPHA * between[rows[has], first[has]] > to_node[has]
    return out


def build(x: np.ndarray) -> np.ndarray:
    """The pruned graph of a cell: nearest candidates, pruned; then edges back, pruned again."""
    n = len(x)
    k = min(CANDIDATES, n)
    near = np.empty((n, k), np.int64)
    for at in range(0, n, 512):
        close = x[at : at + 512] @ x.T
        best = np.argpartition(-close, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(close, best, axis=1), axis=1, kind="stable")
        near[at : at + 512] = np.take_along_axis(best, order, axis=1)
    graph = np.concatenate([prune(x, np.arange(a, min(n, a + 256)), near[a : a + 256]) for a in range(0, n, 256)])
    # edges back: a node takes as many of those that point to it, nearest first, as it has candidates
    source, target = np.repeat(np.arange(n), DEGREE), graph.ravel()
    source, target = source[target >= 0], target[target >= 0]
    both = np.unique(np.concatenate([target * n + source, source * n + target]))
    a, b = both // n, both % n
    order = np.lexsort((-np.einsum("nd,nd->n", x[a], x[b]), a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    kept = place < CANDIDATES
    wide = np.full((n, CANDIDATES), -1, np.int64)
    wide[a[kept], place[kept]] = b[kept]
    return np.concatenate([prune(x, np.arange(i, min(n, i + 256)), wide[i : i + 256]) for i in range(0, n, 256)])


def neighbours(graph: np.ndarray) -> list[np.ndarray]:
    """Each node's list: its own edges, and edges back to the nodes that count it among their BACK first.

    Pruning alone leaves nodes of dense groups that no list names; so each is named by some.
    """
    n = len(graph)
    source, target = np.repeat(np.arange(n), BACK), graph[:, :BACK].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    back = np.split(source[order], np.searchsorted(target[order], np.arange(1, n)))
    return [np.union1d(g[g >= 0], b) for g, b in zip(graph, back, strict=True)]


def medoids(x: np.ndarray) -> np.ndarray:
    """Entry points: the rows nearest to the means of a few slices."""
    groups = centres_of(x[: 64 * MEDOIDS], MEDOIDS)
    return np.unique((x @ groups.T).argmax(axis=0))


def cosines(x: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.empty(len(q))
    for at in range(0, len(q), PAIRS):
        s = slice(at, at + PAIRS)
        out[s] = np.einsum("nd,nd->n", x[q[s]], x[v[s]])
    return out


def search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, other row) with cosine >= threshold: greedy from `entries` and the query's own node, then expanding over the range."""
    m, n = len(queries), len(x)
    seen = np.zeros((m, n), bool)
    top_node = np.full((m, beam), -1, np.int64)
    top_value = np.full((m, beam), -2.0)
    done = np.zeros((m, beam), bool)
    slack = 2 * threshold * threshold - 1 if threshold > 0 else -1  # twice the angle: what may lead to the range
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def visit(row, node):
        fresh = (node >= 0) & ~seen[row, np.maximum(node, 0)]
        row, node = row[fresh], node[fresh]
        keys = np.unique(row * n + node)
        row, node = keys // n, keys % n
        seen[row, node] = True
        value = cosines(x, queries[row], node)
        near = value >= slack
        hits.append((row[near], node[near], value[near]))
        return row, node, value

    row, node, value = visit(np.concatenate([np.repeat(np.arange(m), len(entries)), np.arange(m)]), np.concatenate([np.tile(entries, m), queries]))
    while True:
        # merge what was visited into each query's beam
        if len(row):
            order = np.lexsort((-value, row))
            row, node, value = row[order], node[order], value[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            ok = place < beam
            width = int(place[ok].max()) + 1
            more_node, more_value = np.full((m, width), -1, np.int64), np.full((m, width), -2.0)
            more_node[row[ok], place[ok]], more_value[row[ok], place[ok]] = node[ok], value[ok]
            all_node, all_value = np.concatenate([top_node, more_node], 1), np.concatenate([top_value, more_value], 1)
            all_done = np.concatenate([done, np.zeros((m, width), bool)], 1)
            best = np.argsort(-all_value, axis=1, kind="stable")[:, :beam]
            top_node, top_value, done = (np.take_along_axis(t, best, 1) for t in (all_node, all_value, all_done))
        open_ = ~done & (top_node >= 0)
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(rows):
            break
        # the nearest few open nodes of each query at once
        rank = np.cumsum(open_, axis=1)
        take_row, take_at = np.nonzero(open_ & (rank <= 4))
        done[take_row, take_at] = True
        around = graph[top_node[take_row, take_at]]
        row, node, value = visit(np.repeat(take_row, around.shape[1]), around.ravel())
    # range expansion: every row within twice the angle leads on
    at = 0
    expanded = np.zeros((m, n), bool)
    expanded_row, expanded_node = np.nonzero(np.zeros((0, 0)))
    while at < len(hits):
        row, node, _ = hits[at]
        at += 1
        fresh = ~expanded[row, node]
        row, node = row[fresh], node[fresh]
        expanded[row, node] = True
        for i in range(0, len(row), PAIRS // 16):
            around = graph[node[i : i + PAIRS // 16]]
            visit(np.repeat(row[i : i + PAIRS // 16], around.shape[1]), around.ravel())
    row, node, value = (np.concatenate(c) for c in zip(*hits, strict=True))
    linked = (value >= threshold) & (queries[row] != node)
    return row[linked], node[linked]


def cell_links(x: np.ndarray, graph: np.ndarray, own: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All links (row, other row, whether the graph search finds it) of the rows `own`, in blocks.

    The beam is widened until the audit finds RECALL of its rows' links, WIDEST at most; links that
    the search still misses are added by the exact check that follows.
    """
    entries, beam = medoids(x), BEAM
    audit = own[:: max(1, len(own) // AUDIT)][:AUDIT]
    truth = (x[audit] @ x.T >= threshold) & (np.arange(len(x)) != audit[:, None])
    while beam < min(WIDEST, len(x)):
        found = np.zeros_like(truth)
        found[search(x, graph, audit, entries, threshold, beam)] = True
        if (found & truth).sum() >= RECALL * truth.sum():
            break
        beam *= 2
    for at in range(0, len(own), QUERIES):
        q = own[at : at + QUERIES]
        searched = np.zeros((len(q), len(x)), bool)
        searched[search(x, graph, q, entries, threshold, beam)] = True
        # the exact check: what the search finds, and what it misses
        row, node = np.nonzero(searched | (x[q] @ x.T >= threshold) & (np.arange(len(x)) != q[:, None]))
        yield q[row], node, searched[row, node]


def reach(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The angle between each row and `centre`."""
    return np.arccos(np.clip(x @ centre, -1, 1))


def apart_links(a: dict, b: dict, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All links (row of a, row of b) of two blocks whose ends share no cell.

    A row whose angle to the other block's centre exceeds that block's radius by more than the
    link angle has no link there.
    """
    link = np.arccos(np.clip(threshold, -1, 1)) + 1e-6
    rows = np.flatnonzero(reach(a["x"], b["centre"]) <= b["radius"] + link)
    others = np.flatnonzero(reach(b["x"], a["centre"]) <= a["radius"] + link)
    names = np.intersect1d(a["cells"][rows], b["cells"][others])
    for at in range(0, len(rows) if len(others) else 0, 512):
        r = rows[at : at + 512]
        close = a["x"][r] @ b["x"][others].T >= threshold
        if not close.any():
            continue
        if len(names):
            here, there = ((c[:, :, None] == names).any(axis=1).astype(np.float32) for c in (a["cells"][r], b["cells"][others]))
            close &= here @ there.T == 0
        i, j = np.nonzero(close)
        yield r[i], others[j]


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row that links reach, by repeated minima and jumps."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def matrix(values) -> np.ndarray:
    return unit(np.stack([np.asarray(v, dtype=np.float64) for v in values]))


def near_embeddings(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, recall: bool = False) -> DataFrame:
    """key, n_links, component_id, kept of every row of `vectors`; with `recall`, n_searched too.

    n_searched counts those links that the graph search finds without the exact check that follows,
    so its sum over that of n_links is the recall of the search over the whole table.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as
    do vectors of different lengths. Equal vectors are one node while searching and count one link
    each. A null key joins groups but names none that has another; rows with the same key are
    all kept and count as links of each other where equal. Other columns are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = saved(rows.withColumn("fine", F.coalesce(fine, F.lit(False))), "vectors")
    groups = rows.filter("fine").groupBy("v").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = saved(groups.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    centres: dict[int, np.ndarray] = {}
    for dim, n in sizes.items():
        sample = nodes.filter((F.size("v") == dim) & (F.xxhash64("node") <= F.lit(hash_edge(SAMPLE_ROWS, n)))).orderBy(F.xxhash64("node")).limit(SAMPLE_ROWS).select("v").toPandas()
        centres[dim] = centres_of(matrix(sample["v"]), -(-n // CELL))

    def assigned(centres):
        def run(frames):
            for frame in frames:
                for dim, own in frame.groupby(frame["v"].map(len)):
                    x = matrix(own["v"])
                    cells = cells_of(x, centres[dim])
                    nearest = np.concatenate([np.einsum("nd,nkd->nk", x[i : i + 1024], centres[dim][cells[i : i + 1024]]).argmax(axis=1) for i in range(0, len(x), 1024)])
                    yield pd.DataFrame({"node": own["node"], "dim": dim, "cells": list(cells), "home": cells[np.arange(len(x)), nearest]})

        found = nodes.select("node", "v").mapInPandas(run, "node long, dim int, cells array<int>, home int")
        return found.select("node", "dim", "cells", "home", F.explode("cells").alias("cell"))

    for _ in range(REFINEMENTS):
        cells = saved(assigned(centres), "cells")
        large = cells.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGEST).collect()
        if not large:
            break
        drop_scratch(cells)
        for dim in {r["dim"] for r in large}:
            old, more = centres[dim], []
            for r in (r for r in large if r["dim"] == dim):
                inside = cells_sample(nodes, assigned(centres), dim, r["cell"])
                more.append(centres_of(matrix(inside), -(-r["n"] // CELL)))
            keep = np.setdiff1d(np.arange(len(old)), [r["cell"] for r in large if r["dim"] == dim])
            centres[dim] = np.unique(np.concatenate([old[keep], *more]), axis=0)
    else:
        cells = saved(assigned(centres), "cells")

    members = cells.join(nodes.select("node", "v", "copies"), "node")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def graph_of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        ids = frame["node"].to_numpy()
        return pd.DataFrame({"node": ids, "near": [ids[own] for own in neighbours(build(matrix(frame["v"])))]})

    lists = members.repartition(parts, "dim", "cell").groupBy("dim", "cell").applyInPandas(graph_of, "node long, near array<long>")
    # a list has DEGREE entries for each cell of its node, and those of nodes near it
    united = saved(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")

    def links_of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        ids, x = frame["node"].to_numpy(), matrix(frame["v"])
        lists = [np.searchsorted(ids, own[np.isin(own, ids, assume_unique=True)]) for own in frame["near"]]
        graph = np.full((len(ids), max(1, max(map(len, lists)))), -1, np.int64)
        for i, own in enumerate(lists):
            graph[i, : len(own)] = own
        copies, cells, here = frame["copies"].to_numpy(), np.stack(frame["cells"]), frame["cell"].iloc[0]
        count, hits, label = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.arange(len(ids))
        for a, b, searched in cell_links(x, graph, np.arange(len(ids)), threshold):
            first = first_common(cells[a], cells[b]) == here  # a link counts in one of the cells that both ends share
            np.add.at(count, a[first], copies[b[first]])
            np.add.at(hits, a[first & searched], copies[b[first & searched]])
            # join the components of this block's links with those so far
            label = local_components(len(ids), np.concatenate([np.arange(len(ids)), a]), np.concatenate([label, b]))
        return pd.DataFrame({"node": ids, "links": count, "hits": hits, "head": ids[label]})

    near = members.join(united, "node").repartition(parts, "dim", "cell").groupBy("dim", "cell").applyInPandas(links_of, "node long, links long, hits long, head long")
    near = saved(near, "cell-links").unionByName(saved(links_apart(members, threshold).withColumn("hits", F.lit(0).cast("long")), "apart-links"))
    for done in (cells, united):
        drop_scratch(done)
    part = components(near.select(F.col("node").alias("a"), F.col("head").alias("b")))
    counts = near.groupBy("node").agg(F.sum("links").alias("others"), F.sum("hits").alias("hits"))
    named = nodes.join(counts, "node").withColumn("links", F.col("others") + F.col("copies") - 1).withColumn("hits", F.col("hits") + F.col("copies") - 1).join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = named.groupBy("component").agg(F.min("first").alias("head"))
    homes = named.join(heads, "component").select(F.col("v").alias("home"), "links", "hits", "head")
    out = rows.join(homes, F.col("fine") & (F.col("v") == F.col("home")), "left")
    component = F.when(F.col("fine"), F.col("head")).otherwise(F.col("key"))
    found = [F.coalesce("hits", F.lit(0)).cast("long").alias("n_searched")] if recall else []
    return out.select(F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"), *found)


def links_apart(members: DataFrame, threshold: float) -> DataFrame:
    """node, links, head of the links whose ends share no cell, by exact comparison of blocks.

    A block holds up to about BLOCK nodes of one nearest centre, in a file of the shared folder. Two
    blocks are compared if the angle between their centres is at most their radii and the link angle.
    """
    spark = members.sparkSession
    folder, parts = scratch(spark, "vector-blocks"), max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = members.filter(F.col("cell") == F.col("home"))
    sizes = own.groupBy("dim", "home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("pieces"))
    own = own.join(F.broadcast(sizes), ["dim", "home"]).withColumn("piece", F.pmod(F.xxhash64("node"), "pieces"))

    def block_of(frame: pd.DataFrame) -> pd.DataFrame:
        first, x = frame.iloc[0], matrix(frame["v"])
        mean = x.mean(axis=0)
        size = np.sqrt((mean * mean).sum())
        centre = mean / size if size > 1e-9 else x[0]
        radius, path = float(reach(x, centre).max()), f"{folder}/{first['dim']}-{first['home']}-{first['piece']}"
        out = io.BytesIO()
        np.savez(out, x=x, centre=centre, radius=radius, node=frame["node"].to_numpy(), copies=frame["copies"].to_numpy(), cells=np.stack(frame["cells"]))
        with AtomicFile(path) as f:
            f.write(out.getvalue())
        return pd.DataFrame({"dim": [first["dim"]], "home": [first["home"]], "path": [path], "centre": [centre], "radius": [radius]})

    packed = own.groupBy("dim", "home", "piece").applyInPandas(block_of, "dim int, home int, path string, centre array<double>, radius double")
    blocks = saved(packed, "vector-block-list").toPandas()
    work = []
    for _, g in blocks.groupby("dim"):
        centre, radius, home, path = np.stack(g["centre"]), g["radius"].to_numpy(), g["home"].to_numpy(), g["path"].to_numpy()
        for i in range(len(g)):
            # nodes of one nearest centre share its cell
            near = (reach(centre[i + 1 :], centre[i]) <= radius[i] + radius[i + 1 :] + np.arccos(np.clip(threshold, -1, 1)) + 1e-6) & (home[i + 1 :] != home[i])
            others = path[i + 1 :][near]
            work += [(path[i], others[k : k + RUN].tolist()) for k in range(0, len(others), RUN)]

    def load(path: str) -> dict:
        with np.load(io.BytesIO(read_bytes(path))) as f:
            return {k: f[k] for k in f.files}

    def run(frames):
        for frame in frames:
            for path, others in zip(frame["path"], frame["others"]):
                a = load(path)
                for other in others:
                    b = load(other)
                    n, node = len(a["node"]), np.concatenate([a["node"], b["node"]])
                    count, label = np.zeros(len(node), np.int64), np.arange(len(node))
                    for i, j in apart_links(a, b, threshold):
                        np.add.at(count, i, b["copies"][j])
                        np.add.at(count, n + j, a["copies"][i])
                        label = local_components(len(node), np.concatenate([np.arange(len(node)), i]), np.concatenate([label, n + j]))
                    has = count > 0
                    if has.any():
                        yield pd.DataFrame({"node": node[has], "links": count[has], "head": node[label[has]]})

    tasks = spark.createDataFrame(work, "path string, others array<string>").repartition(max(parts, min(len(work), 4 * parts)))
    return tasks.mapInPandas(run, "node long, links long, head long")


def cells_sample(nodes: DataFrame, cells: DataFrame, dim: int, cell: int) -> list:
    """Vectors of a cell to fit more centres on: SAMPLE_ROWS at most, by hash."""
    inside = cells.filter((F.col("dim") == dim) & (F.col("cell") == cell)).select("node")
    return list(nodes.join(inside, "node").orderBy(F.xxhash64("node")).limit(SAMPLE_ROWS).select("v").toPandas()["v"])
