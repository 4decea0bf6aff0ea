"""Token-id files: tokenise, fit one frequency table, write blocks, read them back."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rans
from .common import AtomicFile, drop_scratch, filesystem, read_bytes, saved, scratch

BLOCK_TOKENS = 1 << 20
CACHE_PIECES = 500_000
CACHE_OTHERS = 100_000
DOCS_AT_ONCE = 4096
TEXT_AT_ONCE = 8 << 20  # characters
#: Parts units that are encoded together; no unit that PLAIN matches holds it.
CUT = "\u0100"
#: Units whose pre-tokenization PIECE gives: printable ASCII, Latin-1 letters and newlines within.
PLAIN = "^[!-~\u00c0-\u00ff]([\n!-~\u00c0-\u00ff]*[!-~\u00c0-\u00ff])?$"
# Fixed value: the pre-tokenizer's pattern, written for those characters.
PIECE = re.compile(CUT + r"|'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ" + CUT + r"]+|\s+(?!\S)|\s+")


def byte_names() -> str:
    """The characters that stand for the 256 bytes: themselves where they can be seen, else from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = iter(range(256, 512))
    return "".join(chr(b) if b in seen else chr(next(hidden)) for b in range(256))


BYTE_NAMES = byte_names()
ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """This worker process's encoder, kept from task to task so that its caches serve all of them."""
    if path not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


class Encoder:
    """The tokenizer's ids of whole texts, with bounded caches of repeated pieces.

    A byte-level pre-tokenizer always cuts before a single space that stands between two characters
    that are no white space, so a text may be encoded in units cut there. Arrow finds the distinct
    units of many texts. Those of plain Latin characters are cut further into the pre-tokenizer's
    own pieces, and each new piece goes through the library's model once; any other unit goes
    through the whole library. A tokenizer of another kind encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens") or []
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        plain_model = model.get("type") == "BPE" and not (model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        fixed = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(map(str.isspace, t["content"])) for t in added)
        self.in_units = bool(byte_level and plain_model and fixed and not spec.get("normalizer"))
        self.added = [t["content"] for t in added]
        if self.in_units:
            # the same model behind a plain cut, for pieces that are already written in the bytes' names
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(BYTE_NAMES[11])
            self.wide = np.zeros(max(model["vocab"].values()) + 1, np.int64)  # bytes of each token
            for token, number in model["vocab"].items():
                self.wide[number] = len(token)
            self.pieces: dict[str, int] = {}
            self.flat, self.start, self.length = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)
            self.forget()

    def forget(self) -> None:
        """Keep the pieces that most calls use, half of the bound at most."""
        keep, least = np.zeros(1, np.int64), 2
        if self.pieces:
            keep = np.flatnonzero(self.uses[: len(self.pieces)] >= least)
            while len(keep) > CACHE_PIECES // 2:
                least += 1
                keep = np.flatnonzero(self.uses[: len(self.pieces)] >= least)
            keep = np.union1d(keep, [0])
        names = list(self.pieces) or [CUT]  # a cut has no ids
        length, room = self.length[keep], max(1 << 12, 2 * len(keep))
        flat = gathered(self.flat, self.start[keep], length)
        self.pieces = {names[i]: at for at, i in enumerate(keep.tolist())}
        self.others: dict[str, bytes] = {}
        self.flat, self.used = np.concatenate([flat, np.zeros(max(1 << 16, len(flat)), "<u4")]), len(flat)
        self.start, self.length, self.uses = (np.zeros(room, np.int64) for _ in range(3))
        self.start[: len(keep)], self.length[: len(keep)] = np.cumsum(length) - length, length

    def plain(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, straight from the library."""
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, fresh: list[str]) -> None:
        """Ids of new pieces, by the library's model; where one ends follows from the widths of its tokens."""
        first = len(self.pieces)
        self.pieces.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        for at in range(0, len(fresh), 2000):
            some = fresh[at : at + 2000]
            named = "\x0b".join(some).encode().decode("latin-1").translate(BYTE_NAMES)
            ids = np.array(self.model.encode_batch_fast([named], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.searchsorted(np.cumsum(self.wide[ids]), np.cumsum(list(map(len, named.split(BYTE_NAMES[11]))))) + 1
            sizes = np.diff(ends, prepend=0)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), "<u4")])
            while first + at + len(some) > len(self.start):
                self.start, self.length, self.uses = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.length, self.uses))
            own = slice(first + at, first + at + len(some))
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[own], self.length[own] = self.used + ends - sizes, sizes
            self.used += len(ids)

    def by_pieces(self, joined: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of n units of PLAIN characters with CUT between them."""
        pieces = PIECE.findall(joined)
        place = np.array(list(map(self.pieces.get, pieces, repeat(-1))), np.int64)
        missing = np.flatnonzero(place < 0).tolist()
        if missing:
            names = [pieces[i] for i in missing]
            self.learn(list(dict.fromkeys(names)))
            place[missing] = list(map(self.pieces.__getitem__, names))
        begin = np.concatenate([[0], np.flatnonzero(place == 0) + 1])
        if len(begin) != n:
            raise ValueError("a unit holds the mark that parts units")
        self.uses[place] += 1  # once for each, however often it occurs
        lengths = self.length[place]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return gathered(self.flat, self.start[place], lengths), np.diff(np.append(total[begin], total[-1]))

    def library(self, units: list[str]) -> list[bytes]:
        """Ids of units of any characters, through the whole library."""
        fresh = list(dict.fromkeys(u for u in units if u not in self.others))
        self.others.update(zip(fresh, self.plain(fresh), strict=True))
        return [self.others[u] for u in units]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; number of ids of each)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.in_units or not texts:
            encoded = self.plain(texts)
            return np.frombuffer(b"".join(encoded), "<u4"), np.array([len(e) // 4 for e in encoded], np.int64)
        if len(self.pieces) > CACHE_PIECES or len(self.others) > CACHE_OTHERS:
            self.forget()
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        edges = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        begin, end = edges[:-1] - edges[0], edges[1:] - edges[0]
        coded = split.flatten().dictionary_encode()
        distinct, unit = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        plain = pc.match_substring_regex(distinct, PLAIN)
        for content in self.added:
            plain = pc.and_not(plain, pc.match_substring(distinct, content))
        easy = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        place = np.full(len(distinct), -1, np.int64)
        place[easy] = np.arange(len(easy))
        parts, lengths = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        if len(easy):
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(easy)], distinct.take(pa.array(easy))), CUT + " ")[0].as_py()
            ids, n = self.by_pieces(" " + joined, len(easy))
            parts.append(ids), lengths.append(n)
        # the rest: a text whose inner units have white space at their ends is joined again there
        rest = {int(i): distinct[int(i)].as_py() for i in np.flatnonzero(place < 0)}
        ragged = np.zeros(len(distinct), bool)
        ragged[[i for i, u in rest.items() if not u or u[0].isspace() or u[-1].isspace()]] = True
        odd = np.flatnonzero(np.logical_or.reduceat(ragged[unit], begin) & (end - begin > 1)).tolist()
        sound = [i for i in rest if not ragged[i]]
        again = [self.joined(texts[i]) for i in odd]
        heads = [u.as_py() for u in distinct.take(pa.array(unit[begin]))]
        for i, units in zip(odd, again, strict=True):
            heads[i] = units[0]
        extra = self.library([" " + rest[i] for i in sound] + heads + [" " + u for units in again for u in units[1:]])
        parts.append(np.frombuffer(b"".join(extra), "<u4"))
        lengths.append(np.fromiter(map(len, extra), np.int64, len(extra)) // 4)
        place[sound] = len(easy) + np.arange(len(sound))
        at = place[unit]
        at[begin] = len(easy) + len(sound) + np.arange(len(texts))
        if odd:
            groups, free = np.split(at, begin[1:]), len(easy) + len(sound) + len(texts)
            for i, units in zip(odd, again, strict=True):
                groups[i] = np.append(groups[i][:1], np.arange(free, free + len(units) - 1))
                free += len(units) - 1
            at, end = np.concatenate(groups), np.cumsum([len(g) for g in groups])
            begin = np.concatenate([[0], end[:-1]])
        flat, size = np.concatenate(parts), np.concatenate(lengths)
        return gathered(flat, (np.cumsum(size) - size)[at], size[at]), np.add.reduceat(size[at], begin)

    @staticmethod
    def joined(text: str) -> list[str]:
        """The units of a text cut only where the space is a sure cut."""
        out: list[str] = []
        for u in text.split(" "):
            if out and (not out[-1] or out[-1][-1].isspace() or not u or u[0].isspace()):
                out[-1] += " " + u
            else:
                out.append(u)
        return out


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + length], one after the other."""
    ends = np.cumsum(length)
    source = np.repeat(start - (ends - length), length)
    source += np.arange(len(source))
    return flat[source]


def pack(ids: bytes, compressor=None) -> bytes:
    """32-bit ids as zstd: 16 bits each where they fit."""
    import zstandard

    compressor = compressor or zstandard.ZstdCompressor(level=1)
    wide = np.frombuffer(ids, "<u4")
    narrow = len(wide) == 0 or wide.max() < 1 << 16
    return bytes([int(narrow)]) + compressor.compress(wide.astype("<u2").tobytes() if narrow else ids)


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data[1:])
    return np.frombuffer(raw, "<u2" if data[0] else "<u4")


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id and packed ids (with `end_id` last) of every row; null text counts as empty."""
    def run(batches):
        import pyarrow as pa
        import zstandard

        encoder, compressor = encoder_of(tokenizer_path), zstandard.ZstdCompressor(level=1)
        end = struct.pack("<I", end_id)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = np.cumsum([len(t) for t in texts])
            at = 0
            while at < len(texts):
                stop = min(at + DOCS_AT_ONCE, max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXT_AT_ONCE))))
                ids, lengths = encoder.encode(texts[at:stop])
                raw, edges = memoryview(ids.tobytes()), (4 * np.concatenate([[0], np.cumsum(lengths)])).tolist()
                packed = [pack(bytes(raw[a:b]) + end, compressor) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), pa.array(packed, pa.binary())], ["doc_id", "packed"])
                at = stop

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, packed binary")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """Occurrences of each id over all documents; the driver gets a row per distinct id."""
    def run(batches):
        counts = np.zeros(0, np.int64)
        for frame in batches:
            for at in range(0, len(frame), DOCS_AT_ONCE):
                own = np.bincount(np.concatenate([unpack(b) for b in frame["packed"][at : at + DOCS_AT_ONCE]]))
                if len(own) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(own) - len(counts), np.int64)])
                counts[: len(own)] += own
        found = np.flatnonzero(counts)
        yield pd.DataFrame({"id": found, "n": counts[found]})

    rows = tokens.select("packed").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    out[rows["id"]] = rows["n"]
    return out


def write_ids(tokens: DataFrame, folder: str, table: rans.Table) -> DataFrame:
    """Files of blocks in ascending doc_id order (null first); returns a row for each block.

    Rows: file, offset, bytes, start (ids before the block in its file), tokens. A file ends with
    the same list, its length and its checksum.
    """
    spark = tokens.sparkSession
    with AtomicFile(f"{folder}/table.rant") as out:
        out.write(table.to_bytes())
    table_bytes = table.to_bytes()

    def run(batches):
        from pyspark import TaskContext

        own_table = rans.Table.from_bytes(table_bytes)
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}.rans"
        blocks, at, start = [], 0, 0
        doc_ids, lengths, ids, held = [], [], [], 0
        file = out = None

        def flush():
            nonlocal at, start, held
            known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
            numbers = np.array([d or 0 for d in doc_ids], dtype="<i8")
            listed = zlib.compress(known.tobytes() + numbers.tobytes() + np.array(lengths, dtype="<u8").tobytes(), 1)
            block = rans.encode(np.concatenate(ids).astype(np.int64), own_table, listed, len(doc_ids))
            out.write(block)
            blocks.append((name, at, len(block), start, held))
            at, start, held = at + len(block), start + held, 0
            doc_ids.clear(), lengths.clear(), ids.clear()

        for batch in batches:
            for number, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if file is None:
                    file = AtomicFile(name)
                    out = file.__enter__()
                own = unpack(packed.as_py())
                doc_ids.append(number)
                lengths.append(len(own))
                ids.append(own)
                held += len(own)
                if held >= BLOCK_TOKENS:
                    flush()
        if file is not None:
            if ids:
                flush()
            index = np.array([b[1:] for b in blocks], dtype="<u8").tobytes()
            out.write(index + struct.pack("<4sII", b"RANX", len(blocks), zlib.crc32(index)))
            file.__exit__(None)
        import pyarrow as pa

        columns = list(zip(*blocks, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string())] + [pa.array(c, pa.int64()) for c in columns[1:]], ["file", "offset", "bytes", "start", "tokens"])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = tokens.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("packed"))
    return saved(ordered.mapInArrow(run, "file string, offset long, bytes long, start long, tokens long"), "id-blocks")


def read_ids(blocks: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files block by block."""
    spark = blocks.sparkSession
    files = blocks.groupBy("file").agg(F.sum("tokens").alias("n")).orderBy("file").collect()  # a row for each file
    bases, at = [], 0
    for f in files:
        bases.append((f["file"], at))
        at += f["n"]
    table_file = f"{folder}/table.rant"

    def run(batches):
        table = rans.Table.from_bytes(read_bytes(table_file))
        for frame in batches:
            for name, offset, size, start in zip(frame["file"], frame["offset"], frame["bytes"], frame["begin"], strict=True):
                fs, path = filesystem(name)
                with fs.open_input_file(path) as f:
                    f.seek(offset)
                    ids, listed, docs = rans.decode(f.read(size), table)
                listed = zlib.decompress(listed)
                known = np.frombuffer(listed, np.uint8, docs)
                numbers = np.frombuffer(listed, "<i8", docs, docs)
                lengths = np.frombuffer(listed, "<u8", docs, 9 * docs).astype(np.int64)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends, lengths, strict=True)]
                doc = pd.array(numbers, dtype="Int64")
                doc[known == 0] = pd.NA
                yield pd.DataFrame({"doc_id": doc, "start": start + ends - lengths, "n_tokens": lengths, "ids_crc32": crc})

    base = spark.createDataFrame(bases, "file string, base long")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = blocks.join(F.broadcast(base), "file").select("file", "offset", "bytes", (F.col("base") + F.col("start")).alias("begin"))
    return placed.repartition(parts, "file", "offset").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Tokenise all rows of `docs`, write them as id files, and return what the files hold.

    Null text is empty (only `end_id`); a null doc_id comes first and stays null; rows with the
    same doc_id are all kept, ordered by a hash of their ids; extra columns are left out; an empty
    table gives no rows.
    """
    folder = scratch(docs.sparkSession, "token-ids")
    tokens = saved(tokenise(docs, tokenizer_path, end_id), "tokens")
    table = rans.Table.fit(count_ids(tokens))
    blocks = write_ids(tokens, folder, table)
    drop_scratch(tokens)
    return read_ids(blocks, folder)
