import functools
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folio.llm.packing import Bins, best_fill, pack_documents, pack_lengths
from folio.llm.token_files import Reader, Writer, bits_for, pack, read_documents, unpack, write_documents
from folio.llm.token_ids import Encoder
from tests.llm.fixtures import awkward, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return Encoder(VOCABULARY, most_words=2000)


SMALL = Encoder(VOCABULARY, most_words=50)  # forgets its words again and again
PLAIN = Tokenizer.from_file(VOCABULARY)
PLAIN.encode_special_tokens = True


@functools.cache
def _ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab' .,1é 　\n\t\r<|S!#", max_size=30), max_size=5))
def test_word_wise_ids_are_the_librarys(texts):
    assert SMALL.ids(texts) == SMALL.whole(texts)


def test_words_with_marks_and_line_feeds(coder):
    texts = ["The cat, the dog.\nIt's 3,4 o'clock... fine!\nÉté,", "x.,. y,", "a\nb\nc", *[t or "" for _, t in awkward()]]
    assert coder.ids(texts) == coder.whole(texts)


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 31, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1001, dtype=np.uint64).astype("<u4")
    raw = pack(ids, width)
    assert len(raw) == -(-1001 * width // 8)
    assert (unpack(raw, width, 1001) == ids).all()


def test_width_is_the_least():
    assert [bits_for(n) for n in (1, 2, 3, 256, 257, 50_257, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_random_access(tmp_path):
    rng = random.Random(1)
    docs = [np.array([rng.randrange(5000) for _ in range(rng.choice([0, 1, 7, 300]))], "<u4") for _ in range(50)]
    out = Writer(str(tmp_path / "ids.bin"), 13, block_ids=64)
    for k, ids in enumerate(docs):
        out.add(None if k == 0 else k, ids)
    out.close()
    whole = np.concatenate(docs)
    file = Reader(str(tmp_path / "ids.bin"))
    assert file.null[0] and not file.null[1:].any() and list(file.doc_ids[1:]) == list(range(1, 50))
    for _ in range(200):
        a = rng.randrange(len(whole) + 1)
        b = rng.randrange(a, len(whole) + 1)
        assert (file.ids(a, b) == whole[a:b]).all()
    runs = list(file.documents(most_ids=100))
    assert runs[0][0] == 0 and runs[-1][1] == 50 and (np.concatenate([r[2] for r in runs]) == whole).all()


def test_cut_short_files_are_refused(tmp_path):
    out = Writer(str(tmp_path / "ids.bin"), 16)
    out.add(1, np.arange(100, dtype="<u4"))
    out.close()
    raw = (tmp_path / "ids.bin").read_bytes()
    (tmp_path / "cut.bin").write_bytes(raw[:-5])
    with pytest.raises(ValueError):
        Reader(str(tmp_path / "cut.bin"))


def test_files_hold_every_document_in_order(spark):
    rows = awkward()
    got = read_documents(write_documents(table(spark, rows), VOCABULARY, end_id=2, block_ids=1000, tasks=3)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, expected = 0, []
    for doc_id, text in order:
        ids = np.array([*_ids(text), 2], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted([tuple(r) for r in got], key=lambda r: r[1]) == expected
    assert read_documents(write_documents(table(spark, []), VOCABULARY)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=5), st.integers(0, 40))
def test_best_fill_is_optimal(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    used, total = best_fill(counts, room)
    assert total == max(s for s in sums if s <= room)
    assert sum(k * n for k, n in used.items()) == total and all(n <= counts[k] for k, n in used.items())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.sampled_from([1, 8, 16, 64]))
def test_every_id_lies_in_one_piece_and_windows_are_full(lengths, capacity):
    pieces = pack_lengths(lengths, capacity)
    spans, windows = {}, {}
    for item, start, length, window, offset in pieces:
        spans.setdefault(item, []).append((start, length))
        windows.setdefault(window, []).append((offset, length))
    assert set(spans) == set(range(len(lengths)))
    for item, parts in spans.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == lengths[item]
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)


def test_packed_documents(spark):
    rows = awkward()
    docs = table(spark, rows)
    got = pack_documents(docs, VOCABULARY, capacity=64, tasks=3, with_ids=True, most_ids=5000).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, pack_documents(docs.repartition(7), VOCABULARY, capacity=64, tasks=3, with_ids=True, most_ids=5000).collect()), key=str)
    assert sum(r.length for r in got) == sum(len(_ids(t)) + 1 for _, t in rows)
    for r in got:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        if sum(1 for i, _ in rows if i == r.doc_id) == 1:
            text = next(t for i, t in rows if i == r.doc_id)
            assert [*_ids(text), 0][r.start : r.start + r.length] == r.ids
    assert pack_documents(table(spark, []), VOCABULARY).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab.'\x85\x1c᠎​\xa0 \n\r", max_size=12), max_size=6))
def test_white_space_of_all_kinds_is_the_librarys(texts):
    assert SMALL.ids(texts) == SMALL.whole(texts)


def test_ids_of_real_words_are_the_librarys(spark, coder):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert coder.ids(texts) == coder.whole(texts) and SMALL.ids(texts[:40]) == coder.whole(texts[:40])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.lists(st.integers(0, 59)), st.sampled_from([8, 64]))
def test_windows_stay_full_when_filled_in_between(lengths, fills, capacity):
    bins, pieces = Bins(capacity), []
    for item, length in enumerate(lengths):
        pieces += bins.add(item, length)
        if item in fills:
            pieces += bins.fill()
    pieces += [*bins.fill(), *bins.finish()]
    held = {}
    for item, start, length, window, offset in pieces:
        held.setdefault(window, []).append((offset, length))
    assert sum(p[2] for p in pieces) == sum(lengths)
    assert sorted(held) == list(range(len(held)))
    sizes = [sum(n for _, n in parts) for _, parts in sorted(held.items())]
    short = [n for n in sizes if n < capacity]
    assert all(n & (n - 1) == 0 for n in short) and len(short) == len(set(short)) == bin(sum(lengths) % capacity).count("1")
