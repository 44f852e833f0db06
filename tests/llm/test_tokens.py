"""Token files and packing against the tokenizers library and exact round trips."""

import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
from samples import ODD, SF
from stratalens.llm import packing, tokenfile
from stratalens.llm.encoding import PieceEncoder

BYTES, WORDY = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ENCODERS = {p: (PieceEncoder(p, limit=50), Tokenizer.from_file(p)) for p in (BYTES, WORDY)}
ids_of = lambda data: list(struct.unpack(f"<{len(data) // 4}I", data))
crc = lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.mark.parametrize("path", [BYTES, WORDY])
@given(texts=st.lists(st.text(st.sampled_from("ab'sZ9é.,!|<>$_ \t\n\r\x0b\x1c\x85\u00a0\u3000中́")), max_size=5))
@settings(max_examples=150, deadline=None)
def test_pieces_give_the_ids_of_the_text(path, texts):
    mine, theirs = ENCODERS[path]
    assert [ids_of(x) for x in mine(texts)] == [theirs.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path", [BYTES, WORDY])
def test_odd_texts(path):
    mine, theirs = ENCODERS[path]
    texts = [t or "" for _, t, _ in ODD]
    assert [ids_of(x) for x in mine(texts)] == [theirs.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path", [BYTES, WORDY])
def test_new_pieces_are_encoded_together(path, monkeypatch):
    """Plain new pieces share texts of the library, pieces seen before need none, and the ids are those of the whole texts."""
    mine, theirs, given = PieceEncoder(path), ENCODERS[path][1], []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return theirs.encode_batch_fast(texts, **options)

    monkeypatch.setattr(mine, "_tokenizer", Counted())
    words = [f"{'abcdefghij'[i % 10]}{'lmnop'[i % 5] * (i % 17)}{i}é{'!' * (i % 2)}" for i in range(1500)]
    texts = [" ".join(words[k::7]) + "<|endoftext|>\n\u3000 x" for k in range(7)] + [f"{'y' * n} {'y' * n}, é{'y' * n}" for n in range(1, 90)]
    wanted = [theirs.encode(t, add_special_tokens=False).ids for t in texts]
    for again in (False, True):
        given.clear()
        assert [ids_of(x) for x in mine(texts)] == wanted
        assert not given if again else len(given) < 200
    few = PieceEncoder(path, limit=400)  # forgets pieces between groups
    assert [[ids_of(x) for x in few(texts[k : k + 3])] for k in range(0, len(texts), 3)] == [wanted[k : k + 3] for k in range(0, len(texts), 3)]
    assert few._n + len(few._longs) < 1500 <= mine._n + len(mine._longs)


def test_columns_are_encoded_as_they_are():
    """A column of texts needs no Python strings, also one that begins inside another and has nulls."""
    texts = ["cut off", "the  old mill.", None, "", "é, 中\u00a0 x", "a" * 40, None, "end"]
    for kind in (pa.string(), pa.large_string()):
        for column in (pa.array(texts, kind).slice(1), pa.array([None] * 3, kind), pa.array([], kind)):
            mine, theirs = ENCODERS[BYTES]
            assert [ids_of(x) for x in mine(column)] == [theirs.encode(t or "", add_special_tokens=False).ids for t in column.to_pylist()]


@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=900))
@settings(max_examples=200, deadline=None)
def test_words_round_trip(ids):
    given_ids = np.array(ids, np.uint64)
    words, raw, offsets = tokenfile.encode_words(given_ids)
    assert (tokenfile.decode_words(words, raw, len(ids)) == given_ids).all()
    for start, end in ((0, len(ids)), (len(ids) // 3, 2 * len(ids) // 3), (max(0, len(ids) - 2), len(ids))):
        assert (tokenfile.decode_range(words, raw, offsets, len(ids), start, end) == given_ids[start:end]).all()


def test_small_ids_take_few_words():
    assert len(tokenfile.encode_words(np.ones(600, np.uint64))[0]) == 10
    assert len(tokenfile.encode_words(np.full(600, 30_000, np.uint64))[0]) == 150


@given(st.lists(st.one_of(st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=300))
@settings(deadline=None)
def test_stored_ids_round_trip(ids):
    data = struct.pack(f"<{len(ids)}I", *ids)
    assert tokenfile._unpacked(*tokenfile._packed(data)) == data


def test_ids_are_moved_and_not_texts(spark, monkeypatch, tmp_path):
    """What is dealt out by doc_id are rows of packed ids, a third of the text's size; rows of one doc_id stay together in the order of their text's hash."""
    text = "the quick brown fox jumps over the lazy dog " * 200
    df = spark.createDataFrame([(i // 2, f"{text}{i}") for i in range(40)], "doc_id long, text string")
    moved, layout = [], tokenfile._layout
    monkeypatch.setattr(tokenfile, "_layout", lambda rows: moved.append(rows) or layout(rows))
    tokenfile.write_tokens(df, str(tmp_path / "tokens"), BYTES, 0)
    assert "text" not in moved[0].columns and all(3 * len(r.ids) < len(text) for r in moved[0].collect())
    got = tokenfile.read_tokens(spark, str(tmp_path / "tokens")).collect()
    sums = {(r.doc_id, crc(ENCODERS[BYTES][1].encode(r.text, add_special_tokens=False).ids + [0])) for r in df.collect()}
    assert {(r.doc_id, r.ids_crc32) for r in got} == sums and len(got) == 40


def test_token_file(spark, documents):
    tokenizer = ENCODERS[BYTES][1]
    got = sorted(entry.queries()["op1_token_file"](spark, SF).collect())
    at = 0
    for row, doc in zip(got, sorted(documents), strict=True):
        ids = tokenizer.encode(documents[doc], add_special_tokens=False).ids + [0]
        assert tuple(row) == (doc, at, len(ids), crc(ids))
        at += len(ids)


def test_token_file_of_odd_rows(odd, empty):
    got = tokenfile.token_digest(odd, BYTES, 0).collect()
    assert len(got) == len(ODD) and sum(r.n_tokens == 1 for r in got) == 2
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    assert tokenfile.token_digest(empty, BYTES, 0).count() == 0


def _whole(rows, texts, tokenizer, end, size):
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_packing(spark, documents):
    assert _whole(entry.queries()["op8_packed_windows"](spark, SF).collect(), documents, ENCODERS[WORDY][1], 1, 2048) == 0


def test_packing_of_odd_rows(odd, empty):
    rows = packing.pack(odd.dropDuplicates(["doc_id", "text"]), WORDY, 1, 64).collect()
    assert _whole(rows, {d: t for d, t, _ in ODD}, ENCODERS[WORDY][1], 1, 64) == 0
    assert packing.pack(empty, WORDY, 1).count() == 0


def test_sum_of_squares_choice():
    packer = packing.SumOfSquares(10)
    levels = [0] * 11
    for n in [3, 3, 4, 7, 2, 6, 5, 5, 8, 1, 9, 2, 2, 3]:
        costs = {}
        for h in [h for h in range(11 - n) if h == 0 or levels[h]]:
            after = levels.copy()
            after[h] -= h > 0
            after[h + n] += h + n < 10
            costs[h] = sum(x * x for x in after)
        best = max(h for h in costs if costs[h] == min(costs.values()))
        levels[best] -= best > 0
        levels[best + n] += best + n < 10
        packer.add(0, b"\0\0\0\0" * n)
        assert packer.levels[1:10].tolist() == levels[1:10]
