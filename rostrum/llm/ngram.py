"""Language-model scoring with an Elias-Fano n-gram trie of two levels in memory-mapped files.

Level 1 is the vocabulary: word hashes in rising order, so a word's id is its rank. Level 2 holds
the words seen after each context word. A context's successors are stored relative to the context's
place, which makes the whole level one rising Elias-Fano sequence that a successor search of
(place, word) goes through; pointers to the ends of the contexts' ranges are a second one. Probabilities (Witten-Bell, interpolated with the smoothed unigram) and
back-off weights are logarithms quantised to 16 bits.

Both levels are split into shards of bounded size. Contexts that are very frequent are split by
successor, so no shard holds a hot word alone. A task maps the shards it needs one at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import AtomicFile, drop_scratch, filesystem, saved, scratch
from .eliasfano import EliasFano
from .shingles import FOLD, Hasher, mix

ADD = 0.1
STEP = 1 / 3000  # of log10; 16 bits reach 21.8
BLOCK_BYTES = 8 << 20
#: Tokens behind one shard of level 2, at most; contexts with more tokens are split.
SHARD_TOKENS = 4_000_000
END = np.uint64(0x5EED5EED5EED5EED)
U = np.uint64


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-log10 / STEP), 65535).astype("<u2")


def token_blocks(batches, text: int):
    """(row parts, token hashes, first token of each row, end) of blocks of whole texts; each text ends with END."""
    hasher = Hasher(1)

    def block(parts, texts):
        folded = [t.encode("utf-8", "surrogatepass").translate(FOLD) for t in texts]
        words, starts = hasher.word_hashes(b" ".join(folded))
        ends = np.searchsorted(starts, np.cumsum([len(f) + 1 for f in folded]))
        tokens = np.insert(words, ends, END)
        ends = ends + np.arange(1, len(ends) + 1)
        return parts, tokens, np.concatenate([[0], ends[:-1]]), ends

    parts, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            own = [t or "" for t in part.column(text).to_pylist()]
            parts.append(part)
            texts += own
            size += sum(map(len, own))
            if size >= BLOCK_BYTES:
                yield block(parts, texts)
                parts, texts, size = [], [], 0
    if texts:
        yield block(parts, texts)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising keys and their counts."""
    import zstandard

    steps = np.diff(keys, prepend=U(0)).astype("<u8")
    raw = steps.view(np.uint8).reshape(-1, 8).T.tobytes()  # by byte, so that high zeros vanish
    narrow = counts.astype("<u4") if len(counts) == 0 or counts.max() < 1 << 32 else counts.astype("<u8")
    return bytes([narrow.itemsize]) + zstandard.ZstdCompressor(level=1).compress(raw + narrow.view(np.uint8).reshape(-1, narrow.itemsize).T.tobytes())


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    wide = data[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    n = len(raw) // (8 + wide)
    steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    counts = np.ascontiguousarray(raw[8 * n :].reshape(wide, n).T).view(f"<u{wide}").ravel()
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def merge_shards(parts: DataFrame, shards: int, name: str) -> DataFrame:
    """(shard, packed) with one row for each shard: keys' counts summed; parts have many rows for each."""
    def merge(key, frames):
        held, waiting, size = (np.zeros(0, U), np.zeros(0, np.int64)), [], 0
        for frame in frames:
            for data in frame["packed"]:
                waiting.append(unpack(data))
                size += len(waiting[-1][0])
                if size > len(held[0]) + 1_000_000:
                    held = summed(np.concatenate([held[0], *(w[0] for w in waiting)]), np.concatenate([held[1], *(w[1] for w in waiting)]))
                    waiting, size = [], 0
        keys, counts = summed(np.concatenate([held[0], *(w[0] for w in waiting)]), np.concatenate([held[1], *(w[1] for w in waiting)]))
        yield pd.DataFrame({"shard": [key[0]], "packed": [pack(keys, counts)], "n": [len(keys)], "tokens": [int(counts.sum())]})

    from collections.abc import Iterator  # noqa: F401  the annotation below is read at run time

    def run(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from merge(key, frames)

    run.__annotations__ = {"key": tuple, "frames": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return saved(parts.repartition(shards, "shard").groupBy("shard").applyInPandas(run, "shard int, packed binary, n long, tokens long"), name)


def by_shard(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """Rising keys dealt to their shards."""
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order], prepend=-1))
    ends = np.append(edges[1:], len(order))
    rows = [(int(shard[order[a]]), pack(keys[order[a:b]], counts[order[a:b]])) for a, b in zip(edges, ends, strict=True)]
    return pd.DataFrame(rows, columns=["shard", "packed"])


def mapped(uri: str) -> np.ndarray:
    """A file's bytes: mapped where the shared folder is mounted, else read (shards are bounded)."""
    from pyarrow import fs

    system, path = filesystem(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    with system.open_input_stream(path) as f:
        return np.frombuffer(f.read(), np.uint8)


class Model:
    """What the driver knows of the trie: bounded by the number of shards and of split contexts."""

    def __init__(self, folder: str, bits: int, sizes: list[int], tokens: int, documents: int):
        self.folder, self.bits, self.tokens, self.documents = folder, bits, tokens, documents
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.vocabulary = int(self.offsets[-1])
        self.stride = self.vocabulary + 2  # room for a context's successors, and for an unknown word
        self.shards = max(1, -(-tokens // SHARD_TOKENS))
        self.kinds: dict[int, int] = {}  # successors of split contexts

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADD) / (self.tokens + ADD * (self.vocabulary + 1)))

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of rising distinct hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        edges = np.searchsorted(hashes, np.arange(1, 1 << self.bits, dtype=U) << U(64 - self.bits)) if self.bits else []
        edges = np.concatenate([[0], edges, [len(hashes)]]).astype(np.int64)
        for shard, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a == b or self.offsets[shard] == self.offsets[shard + 1]:
                continue
            data = mapped(f"{self.folder}/words-{shard:05d}.eft")
            level, at = EliasFano.read(data, 0)
            table = np.frombuffer(data, "<u8", level.n, at)
            own = hashes[a:b] - (U(shard) << U(64 - self.bits) if self.bits else U(0))
            found = level.index_of(own)
            ok = found >= 0
            ids[a:b] = np.where(ok, found + self.offsets[shard], -1)
            counts[a:b] = np.where(ok, table[found].astype(np.int64), 0)
        return ids, counts

    def shard_of(self, context: np.ndarray, word: np.ndarray, context_count: np.ndarray) -> np.ndarray:
        """Level-2 shard: by context, and by successor too where the context is frequent."""
        pieces = np.maximum(1, -(-context_count // SHARD_TOKENS)).astype(U)
        salt = mix(word.astype(U)) % pieces
        return (mix(context.astype(U) * U(0x9E3779B97F4A7C15) + salt) % U(self.shards)).astype(np.int64)

    def pairs(self, tokens: np.ndarray, starts: np.ndarray):
        """Ids and counts of each token, and (distinct pair key, place of each token's pair) with -1 for no pair."""
        unique, back = np.unique(tokens, return_inverse=True)
        ids, counts = self.words(unique)
        ids, counts = ids[back], counts[back]
        context = np.concatenate([[-1], ids[:-1]])
        context_count = np.concatenate([[0], counts[:-1]])
        context[starts], context_count[starts] = self.vocabulary, self.documents
        return ids, counts, context, context_count


def learn_words(train: DataFrame, folder: str) -> tuple[Model, DataFrame]:
    """Level 1, from all rows of `train` (text, first column)."""
    spark = train.sparkSession
    bits = max(2, (train.rdd.getNumPartitions() - 1).bit_length())

    def count(batches):
        import pyarrow as pa

        for _, tokens, starts, _ in token_blocks(batches, 0):
            keys, counts = np.unique(tokens, return_counts=True)
            frame = by_shard((keys >> U(64 - bits)).astype(np.int64), keys, counts)
            yield pa.RecordBatch.from_pandas(frame.assign(documents=[len(starts)] + [0] * (len(frame) - 1)), schema=pa.schema([("shard", pa.int32()), ("packed", pa.binary()), ("documents", pa.int64())]), preserve_index=False)

    parts = saved(train.mapInArrow(count, "shard int, packed binary, documents long"), "word-parts")
    documents = parts.agg(F.sum("documents")).first()[0] or 0
    merged = merge_shards(parts.select("shard", "packed"), 1 << bits, "words")
    drop_scratch(parts)

    def write(batches):
        for frame in batches:
            for shard, data in zip(frame["shard"], frame["packed"], strict=True):
                keys, counts = unpack(data)
                with AtomicFile(f"{folder}/words-{shard:05d}.eft") as out:
                    out.write(EliasFano.to_bytes(keys - (U(shard) << U(64 - bits))))
                    out.write(counts.astype("<u8").tobytes())
                yield pd.DataFrame({"shard": [shard], "n": [len(keys)], "tokens": [int(counts.sum())]})

    rows = saved(merged.select("shard", "packed").mapInPandas(write, "shard int, n long, tokens long"), "word-shards").collect()  # a row for each shard
    drop_scratch(merged)
    sizes = [0] * (1 << bits)
    for r in rows:
        sizes[r["shard"]] = r["n"]
    return Model(folder, bits, sizes, sum(r["tokens"] for r in rows), documents), spark


def learn(train: DataFrame, folder: str) -> Model:
    """The whole trie from all rows of `train` (text)."""
    model, _ = learn_words(train, folder)
    width = U(model.vocabulary + 1)

    def count(batches):
        import pyarrow as pa

        for _, tokens, starts, _ in token_blocks(batches, 0):
            ids, _, context, context_count = model.pairs(tokens, starts)
            order = np.argsort(context.astype(U) * width + ids.astype(U), kind="stable")
            keys = (context.astype(U) * width + ids.astype(U))[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            shard = model.shard_of(context[order[first]], ids[order[first]], context_count[order[first]])
            frame = by_shard(shard, keys[first], np.diff(np.append(first, len(keys))))
            yield pa.RecordBatch.from_pandas(frame, schema=pa.schema([("shard", pa.int32()), ("packed", pa.binary())]), preserve_index=False)

    parts = train.mapInArrow(count, "shard int, packed binary")
    merged = merge_shards(parts, model.shards, "pairs")

    def split_contexts(batches):
        for frame in batches:
            for data in frame["packed"]:
                keys, counts = unpack(data)
                context = keys // width
                starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
                kinds = np.diff(np.append(starts, len(keys)))
                total = context_totals(model, context[starts], counts, starts)
                hot = total > SHARD_TOKENS
                yield pd.DataFrame({"context": context[starts][hot].astype(np.int64), "kinds": kinds[hot]})

    if model.tokens > SHARD_TOKENS:  # only then can a context be split
        rows = merged.select("packed").mapInPandas(split_contexts, "context long, kinds long").groupBy("context").agg(F.sum("kinds").alias("kinds")).collect()
        model.kinds = {r["context"]: r["kinds"] for r in rows}

    def write(batches):
        for frame in batches:
            for shard, data in zip(frame["shard"], frame["packed"], strict=True):
                with AtomicFile(f"{folder}/pairs-{shard:05d}.eft") as out:
                    out.write(level_bytes(model, *unpack(data)))
                yield pd.DataFrame({"shard": [shard]})

    saved(merged.select("shard", "packed").mapInPandas(write, "shard int"), "pair-shards")
    drop_scratch(merged)
    return model


def id_counts(model: Model, ids: np.ndarray) -> np.ndarray:
    """Counts of rising word ids; the vocabulary's size stands for the start of a text."""
    out = np.zeros(len(ids), np.int64)
    edges = np.searchsorted(ids, model.offsets)
    for shard, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a < b:
            data = mapped(f"{model.folder}/words-{shard:05d}.eft")
            level, at = EliasFano.read(data, 0)
            out[a:b] = np.frombuffer(data, "<u8", level.n, at)[ids[a:b] - model.offsets[shard]]
    out[edges[-1] :] = model.documents
    return out


def context_totals(model: Model, contexts: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each context occurs. Every word but the end has one successor, so that is its own count."""
    return id_counts(model, contexts.astype(np.int64)) if len(contexts) else np.zeros(0, np.int64)


def level_bytes(model: Model, keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A shard of level 2: contexts, their ranges, relative successors, then quantised weights and probabilities."""
    width = U(model.vocabulary + 1)
    context, word = keys // width, (keys % width).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
    own = context[starts]
    ends = np.append(starts[1:], len(keys)).astype(np.int64)
    kinds = ends - starts
    for i, c in enumerate(own.astype(np.int64)) if model.kinds else ():
        kinds[i] = model.kinds.get(int(c), kinds[i])
    total = context_totals(model, own, counts, starts)
    each = np.repeat(np.arange(len(own)), ends - starts)
    unique, back = np.unique(word, return_inverse=True)
    lower = 10 ** model.unigram(id_counts(model, unique)[back])
    chance = (counts + kinds[each] * lower) / (total[each] + kinds[each])
    weight = np.log10(kinds / (total + kinds)) if len(own) else np.zeros(0)
    relative = each.astype(U) * U(model.stride) + word.astype(U)
    return b"".join([EliasFano.to_bytes(own), EliasFano.to_bytes(ends), EliasFano.to_bytes(relative), quantised(weight).tobytes(), quantised(np.log10(chance) if len(keys) else np.zeros(0)).tobytes()])


class Level:
    """A mapped shard of level 2."""

    def __init__(self, uri: str, stride: int):
        data, self.stride = mapped(uri), stride
        self.contexts, at = EliasFano.read(data, 0)
        self.ends, at = EliasFano.read(data, at)
        self.relative, at = EliasFano.read(data, at)
        self.weights = np.frombuffer(data, "<u2", self.contexts.n, at)
        self.chances = np.frombuffer(data, "<u2", self.relative.n, at + 2 * self.contexts.n)

    def look_up(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability or NaN, log10 back-off weight or 0) of context-word pairs in order of context."""
        chance, weight = np.full(len(context), np.nan), np.zeros(len(context))
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        place = np.repeat(self.contexts.index_of(context[first].astype(U)), np.diff(np.append(first, len(context))))
        known = np.flatnonzero(place >= 0)
        weight[known] = self.weights[place[known]] * -STEP
        found = self.relative.index_of(place[known].astype(U) * U(self.stride) + word[known].astype(U))
        ok = found >= 0
        chance[known[ok]] = self.chances[found[ok]] * -STEP
        return chance, weight

    def successors(self, context: int) -> np.ndarray:
        """Word ids seen after a context: the range between its pointer and the one before."""
        (at,) = self.contexts.index_of(np.array([context], U))
        if at < 0:
            return np.zeros(0, np.int64)
        start = int(self.ends.get(np.array([at - 1]))[0]) if at else 0
        own = np.arange(start, int(self.ends.get(np.array([at]))[0]))
        return (self.relative.get(own) - U(int(at) * self.stride)).astype(np.int64)


def score_tokens(model: Model, levels, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, unigram log10, model log10) of each token."""
    ids, counts, context, context_count = model.pairs(tokens, starts)
    base = model.unigram(counts)
    out = base.copy()
    ask = np.flatnonzero(context >= 0)
    if len(ask) and model.tokens:
        # an unknown word takes the place after the last, which no context has
        key = context[ask].astype(U) * U(model.stride) + np.where(ids[ask] < 0, model.vocabulary + 1, ids[ask]).astype(U)
        unique, first, back = np.unique(key, return_index=True, return_inverse=True)
        c, w, n = context[ask][first], np.where(ids[ask][first] < 0, model.vocabulary + 1, ids[ask][first]), context_count[ask][first]
        shard = model.shard_of(c, w, n)
        chance, weight = np.full(len(unique), np.nan), np.zeros(len(unique))
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(model.shards + 1))
        for s in range(model.shards):
            own = order[edges[s] : edges[s + 1]]
            level = levels(s) if len(own) else None
            if level is not None:
                chance[own], weight[own] = level.look_up(c[own], w[own])
        out[ask] = np.where(np.isnan(chance[back]), base[ask] + weight[back], chance[back])
    return counts > 0, base, out


def score(docs: DataFrame, model: Model, pieces: list[str]) -> DataFrame:
    """The columns `pieces` of `docs` (which ends with the text) with n_tokens, n_known, train_tokens, base_score, score."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    held = set(list_files(docs, model.folder, "pairs-"))

    def run(batches):
        import pyarrow as pa

        def levels(shard):
            name = f"pairs-{shard:05d}.eft"
            return Level(f"{model.folder}/{name}", model.stride) if name in held else None

        for parts, tokens, starts, ends in token_blocks(batches, len(pieces)):
            known, base, own = score_tokens(model, levels, tokens, starts)
            sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), base, own)]
            at = 0
            for part in parts:
                rows = slice(at, at + part.num_rows)
                at += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array((ends - starts)[rows]), pa.array(sums[0][rows]), pa.array(np.full(part.num_rows, model.tokens, np.int64)), pa.array(sums[1][rows]), pa.array(sums[2][rows])],
                    [*pieces, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return docs.mapInArrow(run, schema + ", n_tokens long, n_known long, train_tokens long, base_score double, score double")


def list_files(df: DataFrame, folder: str, prefix: str) -> list[str]:
    from pyarrow import fs

    system, path = filesystem(folder)
    return [f.base_name for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.base_name.startswith(prefix)]


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs`.

    Learns from all rows whose crc32(doc_id) mod 10 is not 0; a null doc_id is neither held out nor
    learned from. Null text is empty: its one token is the end. Repeated rows count as often as
    they occur. Without training rows every token has the chance 0.1 / (0.1 * 1). Other columns
    are left out.
    """
    folder = scratch(docs.sparkSession, "ngrams")
    train = docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("text")
    model = learn(train, folder)
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return score(rows, model, ["doc_id", "held_out"])
