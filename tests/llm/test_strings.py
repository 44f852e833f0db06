"""Repeated bytes, spelling variants and token alignment against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
from samples import ODD, SF
from stratalens.llm import alignment, suffixes, variants

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def rows(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def repeats(table, length=50):
    first = {}
    key = lambda d: 1 << 63 if d is None else d
    for doc, text in table:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            first[s] = min(first.get(s, 1 << 64), key(doc))
    out = []
    for doc, text in table:
        data, reach = (text or "").encode(), 0
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < key(doc):
                for k in range(max(i, reach), i + length):
                    gone[k] = 1
                reach = i + length
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((-1 if doc is None else doc, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_cover_has_every_difference():
    assert {(a - b) % suffixes._PERIOD for a in suffixes._COVER for b in suffixes._COVER} == set(range(suffixes._PERIOD))


@given(st.binary(min_size=60, max_size=300), st.integers(1, 50))
@settings(max_examples=50, deadline=None)
def test_hashes_of_strings(data, length):
    buffer = np.frombuffer(data + data, np.uint8)
    places = np.arange(len(buffer) - length + 1)
    got = suffixes.StringHashes(buffer, length).at(places, length)
    seen = {}
    for place, h in zip(places.tolist(), got.tolist(), strict=True):
        assert seen.setdefault(h, buffer[place : place + length].tobytes()) == buffer[place : place + length].tobytes()
    assert len(seen) == len({buffer[p : p + length].tobytes() for p in places})


def test_packed_lists():
    for kind in (np.uint64, np.int64):
        values = np.array(sorted({0, 5, 2**62, *range(100, 200)}), kind)
        assert suffixes.unpacked(suffixes.packed(values), kind).tolist() == values.tolist()
        assert suffixes.unpacked(suffixes.packed(values[:0]), kind).tolist() == []


def test_repeated_bytes(spark, documents, odd, empty):
    got = rows(entry.queries()["op11_repeated_bytes"](spark, SF))
    assert got == repeats(list(documents.items()))
    assert rows(suffixes.digest(suffixes.repeats(odd))) == repeats([(d, t) for d, t, _ in ODD])
    assert suffixes.repeats(empty).count() == 0


@pytest.mark.parametrize(("seed", "length"), [(1, 50), (2, 50), (3, 31), (4, 90)])
def test_repeated_bytes_of_many_sources(spark, seed, length):
    chance = random.Random(seed)
    bank = ["".join(chance.choice("ab") for _ in range(chance.choice([length - 1, length, length + 1, length + 20, 2 * length]))) for _ in range(25)]
    pieces = lambda: "".join(chance.choice([chance.choice(bank), "".join(chance.choice("abcdé") for _ in range(chance.randrange(30)))]) for _ in range(chance.randrange(6)))
    table = [(chance.randrange(60) if chance.random() < 0.95 else None, pieces()) for _ in range(300)] + [(7, None)]
    table += [(900 + k, table[5][1] * 3) for k in range(40)]  # a group of copies
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    assert rows(suffixes.digest(suffixes.repeats(df, length))) == repeats(table, length)


def test_repeats_across_small_blocks(spark):
    chance = random.Random(9)
    bank = ["".join(chance.choice("abcdefgh") for _ in range(60)) for _ in range(30)]
    table = [(k, " ".join(chance.choices(bank, k=4))) for k in range(200)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    sizes = [r.n for r in suffixes.blocks(df, rows=7, size=600).selectExpr("size(row_doc) AS n").collect()]
    assert sum(sizes) == 200 and max(sizes) <= 7 and len(sizes) > 20
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(suffixes, "blocks", lambda df, whole=suffixes.blocks: whole(df, rows=7, size=600))
        patch.setattr(suffixes, "_BUCKET_BYTES", 4096)
        assert rows(suffixes.digest(suffixes.repeats(df))) == repeats(table)


def vocabulary(table):
    found = Counter()
    for doc, text in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def word_forms(words):
    near, shorter = {w: set() for w in words}, defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shorter[w[:i] + w[i + 1 :]].add((w, i))
    for rest, found in shorter.items():
        for w, i in found:
            if rest in words:
                near[rest].add(w)
                near[w].add(rest)
            near[w] |= {x for x, k in found if k == i and x != w}
    best = {w: min(((-words[x], x) for x in near[w]), default=(0, None)) for w in words}
    form = {w: x if -n >= 2 * words[w] else None for w, (n, x) in best.items()}
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root)
    return out


def told(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_spelling_variants(spark, documents, odd, empty):
    assert told(entry.queries()["op12_spelling_variants"](spark, SF)) == word_forms(vocabulary(documents.items()))
    assert told(variants.variants(odd)) == word_forms(vocabulary([(d, t) for d, t, _ in ODD]))
    assert variants.variants(empty).count() == 0


def test_variants_of_dense_and_long_words(spark):
    chance = random.Random(3)
    words = {"".join(chance.choice("abé") for _ in range(chance.choice([5, 6, 7, 8]))): chance.randrange(1, 50) for _ in range(2000)}
    for size in (63, 64, 65, 66, 200):
        base = "".join(chance.choice("ab") for _ in range(size))
        words[base] = 9
        for i in (0, 5, size // 2, size - 1):
            words |= {base[:i] + base[i + 1 :]: 3, base[:i] + "z" + base[i + 1 :]: 4, base[:i] + "y" + base[i:]: 5}
    words |= {"x" * n: n for n in (63, 64, 65, 66)} | {"chain" + "n" * k: 2**k for k in range(1, 12)}
    assert told(variants.forms(spark.createDataFrame(list(words.items()), "word string, n long"))) == word_forms(words)


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 9)), min_size=1, max_size=8, unique_by=lambda x: x[0]).map(sorted))
@settings(max_examples=100, deadline=None)
def test_pivots_weigh_least(grams):
    pairs = [(a, b) for a in range(len(grams)) for b in range(a + 1, len(grams)) if grams[b][0] >= grams[a][0] + 2]
    got = variants.pivots(grams)
    assert bool(got) == bool(pairs)
    if pairs:
        assert tuple(got) in pairs and sum(grams[k][1] for k in got) == min(grams[a][1] + grams[b][1] for a, b in pairs)


def aligned(table):
    a_file, b_file = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_file.encode_special_tokens = True
    entries, letters = {k: e for e, k in a_file.get_vocab().items()}, alignment.byte_alphabet()
    found = []
    for doc, text in table:
        given = (" " + (text or "")).encode()
        a, b = (a_file.encode(" " + text, add_special_tokens=False).ids, b_file.encode(text)) if text else ([], [])
        a_bytes = [bytes(letters[c] for c in entries[i]) for i in a]
        b_bytes = [bytes([int(b_file.id_to_piece(i)[3:5], 16)]) if b_file.is_byte(i) else b_file.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != given or b"".join(b_bytes) != given:
            found.append((doc, [], [], [], []))
            continue
        a_ends, b_ends = np.cumsum([0, *map(len, a_bytes)]).tolist(), np.cumsum([0, *map(len, b_bytes)]).tolist()
        links, low = [], 0
        for i in range(len(a)):
            while b_ends[low + 1] <= a_ends[i]:
                low += 1
            j = low
            while j < len(b) and b_ends[j] < a_ends[i + 1]:
                links.append((a[i], b[j]))
                j += 1
        groups, i, j = [], 0, 0
        for cut in sorted(set(a_ends[1:]) & set(b_ends[1:])):
            x, y = a_ends.index(cut, i), b_ends.index(cut, j)
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        found.append((doc, a, b, links, groups))
    counts = Counter(p for x in found for p in set(x[3]))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    shown = lambda groups: hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()
    return sorted((-1 if d is None else d, len(a), len(b), len(g), len(k), sum(len(x) * len(y) for x, y in g), sum(counts[p] == best[p[0]] for p in k), sum(counts[p] for p in k), shown(g) if a else "")
                  for d, a, b, k, g in found)


def test_token_alignment(spark, documents, empty):
    assert rows(entry.queries()["op13_token_alignment"](spark, SF)) == aligned(list(documents.items()))
    assert alignment.align(empty, BYTES, PIECES).count() == 0


def test_alignment_of_odd_texts(spark, odd):
    assert rows(alignment.align(odd, BYTES, PIECES)) == aligned([(d, t) for d, t, _ in ODD])
    table = [(20, "a <|endoftext|> b  <s> </s>\n\n  x ▁ y"), (21, " lead  and trail  "), (22, "\n x\t \n"), (23, "it's  ok 　we'll\x1c x 日本 語 \x00 <0x41>"), (24, "x" * 3000 + " y"), (25, " "),
             (26, "▁"), (27, "<|endoftext|>"), (28, "a  b\u0085 c\x1d d\x0b e​ f᠎ g")]
    assert rows(alignment.align(spark.createDataFrame(table, "doc_id long, text string").repartition(3), BYTES, PIECES)) == aligned(table)


@given(st.lists(st.integers(1, 4), max_size=12), st.lists(st.integers(1, 4), max_size=12))
@settings(max_examples=100, deadline=None)
def test_products(a, b):
    cut = lambda x, n: [*x, n - sum(x)] if sum(x) < n else x
    n = max(sum(a), sum(b))
    a, b = np.array(cut(a, n), np.int64), np.array(cut(b, n), np.int64)
    dense = lambda lengths: np.repeat(np.eye(len(lengths), dtype=int), lengths, axis=1)
    want = dense(a) @ dense(b).T
    got = np.zeros_like(want)
    i, j, value = alignment.overlaps(a, b)
    got[i, j] = value
    assert (got == want).all() and (value > 0).all()
    a_of, b_of, _ = alignment.groups(a, b)
    shared = {(int(x), int(y)) for rows_, columns, _ in alignment.shared_groups(a, b) for x, y in zip(rows_, columns, strict=True)}
    assert shared == {(x, y) for x in range(len(a)) for y in range(len(b)) if a_of[x] == b_of[y]}


def test_remembered_segments_change_nothing(monkeypatch):
    """Texts come out the same whole, by segments encoded as one text, and with a memory that forgets nearly all."""
    monkeypatch.setattr(alignment, "_GROUP_CHARS", 300)
    texts = [f"The run {i % 7} of word{i} ended.\nNext über naïve x{i % 3}²" for i in range(60)] + ["two  blanks", "tab\tend ", " ", "\n", "ﬁne ① <s> <|endoftext|>", None, "", "a" * 3000, "No such word"] * 2
    whole, usual, small = alignment.Aligner(BYTES, PIECES), alignment.Aligner(BYTES, PIECES), alignment.Aligner(BYTES, PIECES, limit=6)
    whole._divides = False
    for a in (whole, usual, small):  # a piece that does not give its bytes
        a._b_bytes[a._b.piece_to_id("▁run")] = b" ran"
    results = [[(stats.tolist(), shown, sorted(links.tolist())) for stats, shown, links in a(texts)] for a in (whole, usual, small)]
    assert len(results[0]) == len(texts) and results[0] == results[1] == results[2]
    assert not any(shown for _, shown, _ in results[0][:60]) and results[0][60][1] and results[0][68][1]
    assert len(small._shown) < len(usual._shown)
