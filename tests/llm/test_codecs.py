import io
import random
import math
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rostrum.llm import decontaminate, rans, sharding, shingles, tokens, warc
from rostrum.llm.eliasfano import EliasFano
from rostrum.llm.neardup import banding
from rostrum.llm.shingles import Hasher


@pytest.mark.parametrize("n", [0, 1, 5, 300, 4096 * 3 + 1, 700_000])
def test_rans_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50_000).astype(np.int64)
    table = rans.Table.fit(np.bincount(ids, minlength=50_257))
    table = rans.Table.from_bytes(table.to_bytes())
    block = rans.encode(ids, table, b"listed", 3)
    found, listed, docs = rans.decode(block, table)
    assert (found == ids).all() and listed == b"listed" and docs == 3


def test_rans_checkpoints_start_alone_and_size_is_near_entropy():
    ids = np.random.default_rng(3).integers(0, 64, 2_000_000)
    table = rans.Table.fit(np.bincount(ids))
    block = rans.encode(ids, table, b"", 1)
    (_, n, lanes, rows, _), _, points, stream = rans.parts(block)
    assert len(points) > 2
    row = points[1][0]
    assert (rans.decode_rows(table, stream, n, lanes, points[1], rows) == ids[row * lanes :]).all()
    assert len(block) < 2_000_000 * 6 / 8 * 1.1


def test_rans_damage_is_found():
    ids = np.arange(5000) % 7
    table = rans.Table.fit(np.bincount(ids))
    block = bytearray(rans.encode(ids, table, b"", 1))
    block[-1] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(block), table)


@given(st.lists(st.integers(0, 2**62), max_size=300), st.lists(st.integers(0, 2**62), max_size=30))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values, asked):
    v = np.sort(np.array(values, dtype=np.uint64))
    data = EliasFano.to_bytes(v)
    level, end = EliasFano.read(np.frombuffer(data, np.uint8), 0)
    assert end == len(data)
    assert (level.get(np.arange(len(v))) == v).all()
    q = np.array(asked + values, dtype=np.uint64)
    assert (level.find(q) == np.searchsorted(v, q)).all()


@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 30)), max_size=12), st.integers(1, 9))
@settings(max_examples=100, deadline=None)
def test_schedule_is_longest_processing_time(classes, shards):
    classes = list({s: (s, n) for s, n in classes}.values())
    plan = sharding.schedule(classes, shards)
    load, plain = [0] * shards, [0] * shards
    for size, _, ends in plan:
        for j, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            load[j] += size * (b - a)
        assert ends[-1] == dict(classes)[size]
    for size, n in sorted(classes, reverse=True):
        for _ in range(n):
            j = plain.index(min(plain))
            plain[j] += size
    assert sorted(load) == sorted(plain)


def test_arc_versions_and_old_urls():
    one = warc.arc_head("1", "a.arc") + warc.arc_record("1", "http://x/ ü", "2001", "text/html", b"abc\n\ndef") + b"\n"
    two = warc.arc_head("2", "b.arc") + warc.arc_record("2", None, "20010203040506", None, warc.HTTP_HEAD + b"body", "loc")
    (a,) = warc.read_arc(io.BytesIO(one))
    (b,) = warc.read_arc(io.BytesIO(two))
    assert a["fields"]["URL"] == "http://x/%20ü" and a["body"] == b"abc\n\ndef"
    assert b["fields"]["Location"] == "loc" and b["fields"]["URL"] == "-" and warc.payload_of(b["body"]) == b"body"
    spaced = warc.arc_head("1", "c.arc") + b"http://x/a b 1.2.3.4 20010101000000 text/html 2\nhi\n"
    assert next(warc.read_arc(io.BytesIO(spaced)))["fields"]["URL"] == "http://x/a b"
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(one[:-6])))
    assert warc.warc_date("2001") == "2001-01-01T00:00:00Z" and warc.warc_date("20010203040506") == "2001-02-03T04:05:06Z"


def test_warc_round_trip():
    data = warc.warc_record("response", {"WARC-Record-ID": "<x>"}, b"a\r\n\r\nb") + warc.warc_record("revisit", {"A": None}, b"")
    assert [(h["warc-type"], b) for h, b in warc.read_warc(io.BytesIO(data))] == [("response", b"a\r\n\r\nb"), ("revisit", b"")]


def test_encoder_equals_the_library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    texts = ["", " ", "  ", "a  b", " a", "a ", "x\n y", "a \nb", "it's  ok <|endoftext|> x", "a  b  c", "don 't 's", "é" * 900, "a\x0bb \x0b c", "\x1c a \x85b", "the the the"] * 2
    mixed = random.Random(3)
    signs = " ab1.'\n\t  éß×÷²ªµ\xa0\u3000中x’s\x1c\x85😀-_'s'll"
    texts += ["".join(mixed.choice(signs) for _ in range(mixed.randint(0, 60))) for _ in range(3000)]
    encoder, library = tokens.Encoder(path), Tokenizer.from_file(path)
    assert encoder.in_units
    for part in ([], texts, texts[::-1], texts[:1] * 3):
        ids, lengths = encoder.encode(part)
        assert ids.tolist() == [i for e in library.encode_batch(part, add_special_tokens=False) for i in e.ids]
        assert lengths.tolist() == [len(e.ids) for e in library.encode_batch(part, add_special_tokens=False)]
    encoder.in_units = False  # a tokenizer of another kind goes through the library whole
    ids, lengths = encoder.encode(texts[:20])
    assert ids.tolist() == [i for e in library.encode_batch(texts[:20], add_special_tokens=False) for i in e.ids]


@given(st.lists(st.text(alphabet="abAB \t\n.é", max_size=60), max_size=8), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_shingle_sets_have_the_right_sizes(texts, width):
    fold = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = Hasher(width).sets(texts)
    plain = []
    for t in texts:
        w = t.encode().translate(fold).split()
        plain.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i, p in enumerate(plain):
        for j, q in enumerate(plain):
            assert len(np.intersect1d(sets[i], sets[j])) == len(p & q)


def test_banding_misses_few():
    for share in (0.5, 0.8, 0.85, 0.95):
        bands, rows = banding(share)
        assert (1 - share**rows) ** bands <= 1e-6 or rows == 1
    assert math.prod(banding(0.85)) <= 192


def test_long_words_hash_like_short_ones():
    hasher = Hasher(1)
    words = [b"x" * 5000, b"y" * 70, b"x" * 5000, b"ab"]
    found, _ = hasher.word_hashes(b" ".join(words))
    assert found[0] == found[2] and len(set(found.tolist())) == 3
    many, _ = hasher.word_hashes(b" ".join([b"z" * 80] * 100 + [b"x" * 5000]))
    assert many[-1] == found[0] and zlib.crc32(b"") == 0


@pytest.mark.parametrize("piece", [1, 7, 64, 5000])
def test_pieces_hash_like_the_whole(monkeypatch, piece):
    text = b"  a bc " + b"x" * 9000 + b" d\tefg\n" + b" ".join(b"w%d" % i for i in range(900)) + b"   "
    want = Hasher(1).word_hashes(text)
    monkeypatch.setattr(shingles, "PIECE_BYTES", piece)
    found = Hasher(1).word_hashes(text)
    assert len(want[0]) == 905 and all((f == w).all() for f, w in zip(found, want, strict=True))
    assert not len(Hasher(1).word_hashes(b" " * 50)[0]) and not len(Hasher(1).word_hashes(b"")[0])


def test_a_segment_of_the_index_takes_little_memory():
    class Documents:
        dtypes = [("k", "bigint")]

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802  a DataFrame's method
            return run

    words = np.random.default_rng(1).integers(0, 50_000, 2_300_000).astype(str)  # about 13 MB
    texts = [" ".join(words[i : i + 2300]) for i in range(0, len(words), 2300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["k", "t"])
    run = decontaminate.build_index(Documents(), "k", "t")
    tracemalloc.start()
    try:
        segments = [(s.column(1)[0].as_py(), s.column(4)[0].as_py()) for s in run([batch])]
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert sum(len(lengths) for lengths, _ in segments) == 1000 and sum(map(sum, (lengths for lengths, _ in segments))) == len(words)
    assert sum(len(decontaminate.unpack(places)) for _, places in segments) == len(words)
    assert peak < 120, peak
