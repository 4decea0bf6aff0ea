"""Benchmark decontamination over a distributed positional inverted index of the training documents.

The index is split by document: a segment holds whole documents, and for each of their terms the
sorted places at which they use it. It knows nothing of any benchmark, is written once, and may be
asked for any. Segments are rows of a table in the shared folder, so a lost executor costs only its
segments. A query intersects offset-adjusted lists within each segment, starting from a window's
rarest term there; nothing is shuffled by term or document.

Terms are 64-bit hashes of words. Two of a billion different words share one with a chance of 3 %;
a wrong match needs such a pair at the same place of two otherwise equal windows.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import AtomicFile, read_bytes, saved, scratch
from .shingles import PIECE_BYTES, Hasher

WINDOW = 10
SEGMENT_BYTES = 12 << 20
SEGMENT_DOCUMENTS = 16384
#: Text of test items that a task holds at a time; larger benchmarks are several blocks.
BLOCK_BYTES = 16 << 20
POSITION_BITS = 36

# A-Z fold to a-z; every other ASCII byte but digits and a-z separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def hashes(terms: list[bytes]) -> np.ndarray:
    """The hash of each word."""
    return Hasher(1).word_hashes(b" ".join(terms))[0]


class Windows:
    """Distinct windows of a block of test items, as term numbers; numbers follow the order of the terms' hashes."""

    def __init__(self, items: list[tuple], width: int = WINDOW):
        texts = [(item, words(text)) for item, text in items]
        distinct = sorted({w for _, own in texts for w in own})
        self.hashes, back = np.unique(hashes(distinct), return_inverse=True)
        numbers = dict(zip(distinct, back.tolist(), strict=True))
        owners: dict[tuple, set] = {}
        for item, own in texts:
            terms = [numbers[w] for w in own]
            for at in range(max(1, len(terms) - width + 1) if terms else 0):
                owners.setdefault(tuple(terms[at : at + width]), set()).add(item)
        self.count = len(self.hashes)
        self.length = np.array([len(w) for w in owners], dtype=np.int64)
        self.terms = np.full((len(owners), width), -1, dtype=np.int64)
        for row, w in enumerate(owners):
            self.terms[row, : len(w)] = w
        self.owners = [sorted((i for i in s if i is not None), key=str) for s in owners.values()]


def block_files(benchmark: DataFrame, item: str, text: str, width: int) -> list[str]:
    """Windows of the test items by blocks of bounded size, as files in the shared folder.

    The driver holds one block at a time.
    """
    folder = scratch(benchmark.sparkSession, "benchmark-windows")
    total = benchmark.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0
    parts = max(1, -(-total // BLOCK_BYTES))
    rows = benchmark.filter(F.col(text).isNotNull()).select(F.col(item).alias("i"), F.col(text).alias("t"), F.pmod(F.xxhash64(text), F.lit(parts)).alias("b"))
    names = []
    for b in range(parts):
        names.append(f"{folder}/block-{b:06d}")
        with AtomicFile(names[-1]) as out:
            out.write(pickle.dumps(Windows([(r["i"], r["t"]) for r in rows.filter(F.col("b") == b).collect()], width)))
    return names


def pack(values: np.ndarray) -> bytes:
    """Sorted integers as compressed differences."""
    import zstandard

    steps = np.empty(len(values), "<i8")
    steps[:1] = values[:1]
    np.subtract(values[1:], values[:-1], out=steps[1:])
    return zstandard.ZstdCompressor(level=1).compress(steps)


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8"))


def build_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Segments (keys, lengths, terms, ends, places) of all rows, for all their words.

    terms: rising hashes; ends: where the places of each end; places: rising within a term. Documents lie one
    after the other in a segment's places with a free place between, so that no match crosses
    documents. Null and empty texts have length 0. `key` may be null or repeated.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches):
        import pyarrow as pa

        hasher, arrow_kind = Hasher(1), None
        keys, folded, size = [], [], 0
        hashed, counted, waiting = [], [], 0  # of the documents whose text is let go

        def hash_words():
            nonlocal folded, waiting
            if folded:
                found, starts = hasher.word_hashes(b" ".join(folded))
                ends = np.searchsorted(starts, np.cumsum([len(f) + 1 for f in folded]))
                hashed.append(found)
                counted.append(np.diff(ends, prepend=0))
            folded, waiting = [], 0

        def segment():
            nonlocal hashed, counted
            hash_words()
            found, lengths = np.concatenate(hashed), np.concatenate(counted)
            hashed, counted = [], []
            order = np.argsort(found, kind="stable")
            found = found[order]
            new = np.flatnonzero(found[1:] != found[:-1]) + 1
            terms = found[np.concatenate([np.zeros(min(1, len(found)), np.int64), new])]
            ends = np.append(new, len(found)) if len(found) else new
            del found
            order += np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[order]  # now the places
            # places fall where a new term begins; the differences wrap and come back in the sum
            columns = [pa.array([keys], pa.list_(arrow_kind)), pa.array([lengths], pa.list_(pa.int64())), pa.array([pack(terms.view(np.int64))], pa.binary()), pa.array([pack(ends)], pa.binary()), pa.array([pack(order)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["keys", "lengths", "terms", "ends", "places"])

        for batch in batches:
            arrow_kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    keys.append(k)
                    folded.append(t.encode("utf-8", "surrogatepass").translate(FOLD) if t else b"")
                    size += len(folded[-1])
                    waiting += len(folded[-1])
                    if waiting >= PIECE_BYTES:
                        hash_words()
                    if size >= SEGMENT_BYTES or len(keys) >= SEGMENT_DOCUMENTS:
                        yield segment()
                        keys, folded, size = [], [], 0
        if keys:
            yield segment()

    return docs.select(key, text).mapInArrow(run, f"keys array<{kind}>, lengths array<long>, terms binary, ends binary, places binary")


def postings_of(terms: np.ndarray, ends: np.ndarray, places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """number << POSITION_BITS | place of the wanted terms (rising hashes) in a segment, rising."""
    at = np.searchsorted(terms, wanted)
    at[at == len(terms)] = 0
    there = np.flatnonzero(terms[at] == wanted) if len(terms) else np.zeros(0, np.int64)
    stop = ends[at[there]]
    start = np.where(at[there] > 0, ends[at[there] - 1], 0)
    count = stop - start
    source = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return (np.repeat(there, count) << POSITION_BITS) | places[source]


def contains(postings: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(postings, wanted)
    at[at == len(postings)] = 0
    return postings[at] == wanted if len(postings) else np.zeros(len(wanted), bool)


def phrase_matches(postings: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(window, first place) of all exact occurrences in a segment."""
    n = windows.count
    edges = np.searchsorted(postings, np.arange(n + 1, dtype=np.int64) << POSITION_BITS)
    count = np.diff(edges)
    terms = windows.terms
    there = terms >= 0
    often = np.where(there, count[np.maximum(terms, 0)], np.iinfo(np.int64).max)
    live = np.flatnonzero(np.where(there, often, 1).min(axis=1, initial=1) > 0)
    if not len(live):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(often[live], axis=1, kind="stable")  # offsets by rising frequency of their terms here
    rarest = terms[live, order[:, 0]]
    own = count[rarest]
    which = np.repeat(np.arange(len(live)), own)
    inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    place = (postings[edges[rarest][which] + inside] & ((1 << POSITION_BITS) - 1)) - order[which, 0]
    which, place = which[place >= 0], place[place >= 0]
    for step in range(1, terms.shape[1]):
        if not len(which):
            break
        offset = order[which, step]
        term = terms[live[which], offset]
        ok = (term < 0) | contains(postings, (np.maximum(term, 0) << POSITION_BITS) | (place + offset))
        which, place = which[ok], place[ok]
    return live[which], place


def near_matches(postings: np.ndarray, windows: Windows, slop: int, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, place of its rarest term) where every term lies, as often as in the window, within length - 1 + slop places of that place, in any order and the same document."""
    n = windows.count
    edges = np.searchsorted(postings, np.arange(n + 1, dtype=np.int64) << POSITION_BITS)
    count = np.diff(edges)
    out = [], []
    for w, (terms, length) in enumerate(zip(windows.terms, windows.length, strict=True)):
        terms, times = np.unique(terms[terms >= 0], return_counts=True)
        order = np.argsort(count[terms], kind="stable")
        terms, times = terms[order], times[order]
        place = postings[edges[terms[0]] : edges[terms[0] + 1]] & ((1 << POSITION_BITS) - 1)
        reach = length - 1 + slop
        for t, m in zip(terms, times, strict=True):
            if not len(place):
                break
            doc = np.searchsorted(starts, place, side="right") - 1
            low = np.searchsorted(postings, (t << POSITION_BITS) | np.maximum(place - reach, starts[doc]))
            low += m - 1  # the last of the m occurrences that the window needs
            last = postings[np.minimum(low, len(postings) - 1)]
            place = place[(low < len(postings)) & (last >> POSITION_BITS == t) & ((last & ((1 << POSITION_BITS) - 1)) <= np.minimum(place + reach, starts[doc] + lengths[doc] - 1))]
        out[0].append(np.full(len(place), w))
        out[1].append(place)
    return np.concatenate(out[0] or [np.zeros(0, np.int64)]), np.concatenate(out[1] or [np.zeros(0, np.int64)])


def search(index: DataFrame, blocks: list[str], item_kind: str, slop: int | None = None) -> DataFrame:
    """Rows (key, n_words, spans, items) of all documents of the index, against the windows in all `blocks`.

    spans: merged [start, end) word ranges covered by matches; items: the test items matched. With
    `slop`, matches are near ones, and a span is the place of the rarest term. A task holds one
    block and a batch of segments at a time.
    """
    kind = dict(index.dtypes)["keys"][6:-1]
    schema = f"key {kind}, n_words long, spans array<struct<start:long,end:long>>, items array<{item_kind}>"

    def run(batches):
        import pyarrow as pa

        name = held = None
        for batch in batches:
            lengths = [np.array(x.values.to_numpy(zero_copy_only=False), dtype=np.int64) for x in batch.column(1)]
            found: list[list] = [[] for _ in lengths]
            items: list[dict] = [{} for _ in lengths]
            for block in blocks:
                if block != name:
                    name, held = block, pickle.loads(read_bytes(block))
                for i, (terms, ends, places) in enumerate(zip(batch.column(2), batch.column(3), batch.column(4), strict=True)):
                    starts = np.cumsum(lengths[i] + 1) - lengths[i] - 1
                    postings = postings_of(unpack(terms.as_py()).view(np.uint64), unpack(ends.as_py()), unpack(places.as_py()), held.hashes)
                    if slop is None:
                        which, place = phrase_matches(postings, held)
                        length = held.length[which]
                    else:
                        which, place = near_matches(postings, held, slop, starts, lengths[i])
                        length = np.ones(len(which), np.int64)
                    doc = np.searchsorted(starts, place, side="right") - 1
                    found[i].append(np.stack([doc, place - starts[doc], place - starts[doc] + length]) if len(doc) else np.zeros((3, 0), np.int64))
                    for d, w in set(zip(doc.tolist(), which.tolist(), strict=True)):
                        items[i].setdefault(d, set()).update(held.owners[w])
            for i, keys in enumerate(batch.column(0)):
                spans = spans_by_document(np.concatenate(found[i], axis=1))
                n = len(lengths[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.values,
                        pa.array(lengths[i]),
                        pa.array([spans.get(d, []) for d in range(n)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([sorted(items[i].get(d, ()), key=str) for d in range(n)], pa.list_(arrow_type(item_kind))),
                    ],
                    ["key", "n_words", "spans", "items"],
                )

    return index.mapInArrow(run, schema)


def spans_by_document(found: np.ndarray) -> dict[int, list[dict]]:
    """Overlapping and touching ranges (document, start, end) as one, by document."""
    out: dict[int, list[dict]] = {}
    for d, a, b in found[:, np.lexsort((found[1], found[0]))].T.tolist():
        own = out.setdefault(d, [])
        if own and a <= own[-1]["end"]:
            own[-1]["end"] = max(own[-1]["end"], b)
        else:
            own.append({"start": a, "end": b})
    return out


def arrow_type(kind: str):
    import pyarrow as pa

    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WINDOW, slop: int | None = None) -> DataFrame:
    """(key, n_words, spans, items) of every row of `docs`: exact matches of all windows of all items.

    An item of fewer than `width` words is one window; one without words matches nothing. A null
    item id covers words but is not listed. Null texts have no words; repeated rows are kept.
    """
    item_kind = dict(benchmark.dtypes)[item]
    keyed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    index = saved(build_index(keyed, "key", "text"), "positional-index")
    return search(index, block_files(benchmark, item, item_text, width), item_kind, slop)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row; other columns are left out."""
    found = matches(docs.select("doc_id", "text"), benchmark, width=width)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(F.col("key").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
