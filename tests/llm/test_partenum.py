"""Similar documents against all pairs, and the pipeline's stages."""

import random

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from samples import ODD, SF, WORDS
from stratalens.llm import components, decontaminate, partenum, pii, sentences
from test_texts import ASCII_LOWER, base_pii, base_quality


def shingle_set(text, size=4):
    words = WORDS.findall((text or "").translate(ASCII_LOWER))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(texts):
    """Smallest id each row's links lead to, by all pairs."""
    ids, sets = [d for d, _ in texts], [shingle_set(t) for _, t in texts]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low.setdefault(find(i), []).append(d)
    return sorted((d, len(sets[i]), min(low[find(i)])) for i, d in enumerate(ids))


def test_similar_documents(spark, documents):
    assert sorted(tuple(r) for r in entry.queries()["op4_similar_documents"](spark, SF).collect()) == brute(list(documents.items()))


def test_chains_and_edges_of_the_threshold(spark):
    rng = random.Random(7)
    rows = []
    for n in (1, 3, 5, 9, 24, 60, 140):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(14):
            rows.append((len(rows), " ".join(words)))
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in partenum.groups(df).select("doc_id", "n_shingles", "component_id").collect()) == brute(rows)
    kept = sorted(r.doc_id for r in partenum.deduplicated(df).collect())
    assert kept == sorted({low for _, _, low in brute(rows)})


@pytest.mark.parametrize("size", [1, 2, 4, 7, 13, 40, 200, 900])
def test_similar_sets_share_a_signature(size):
    rng = np.random.default_rng(size)
    scheme = partenum.PartEnum(85, 100)
    for _ in range(60):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        extra = int(len(a) * (100 - 85) / 85)
        b = np.unique(np.concatenate([a, rng.integers(0, 2**63, rng.integers(0, extra + 1)).astype(np.uint64)]))
        assert partenum.linked(a, b, 85, 100)
        assert set(scheme.signatures(a)) & set(scheme.signatures(b))
        bits = np.unpackbits((partenum.sketch(a) ^ partenum.sketch(b)).view(np.uint8)).sum()
        assert bits <= len(np.setxor1d(a, b))


def test_odd_rows(odd, empty):
    got = partenum.groups(odd).collect()
    assert len(got) == len(ODD) and {r.doc_id: r.component_id for r in got if r.n_shingles == 0} == {1: 1, 2: 2, 3: 3}
    assert len({r.first_row for r in got if r.doc_id == 5}) == 1
    kept = partenum.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert partenum.groups(empty).count() == 0 and partenum.deduplicated(empty).count() == 0


def test_null_ids_in_a_class(spark):
    words = [f"w{k}" for k in range(60)]
    copy, near, other = " ".join(words), " ".join([*words[:-1], "else"]), " ".join(reversed(words))
    rows = [(None, copy), (None, copy), (7, copy), (5, near), (None, near), (None, other), (None, other + " end"), (9, "apart")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = partenum.groups(df).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, 5), (7, 5), (5, 5), (None, None), (9, 9)}
    assert sorted(r.doc_id or 0 for r in partenum.deduplicated(df).collect()) == [0, 5, 9]


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (102, 100)], "a long, b long")
    assert {r.node: r.root for r in components.connected(edges).collect()} == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}
    assert components.connected(edges.limit(0)).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    names = random.Random(1).sample(range(10_000), 3000)
    chain = [(a, b) for a, b in zip(names, names[1:], strict=False)]
    valley = [(20_000, 20_080), *((20_000 + k, 20_000 + k - 1) for k in range(80, 1, -1))]
    hub = [(39_999, 30_000 + k) for k in range(9_000)] + [(None, 5)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(chain + valley + hub, "a long, b long")).collect()}
    assert {got[n] for n in names} == {min(names)}
    assert {got[20_000 + k] for k in range(81)} == {20_000}
    assert {got[30_000 + k] for k in range(9_000)} == {30_000} == {got[39_999]}


def test_table_forms_keep_clashing_columns(spark, odd, empty):
    copies = odd.unionByName(odd.where("doc_id = 5"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for form in (partenum.deduplicated, pii.redacted, sentences.removed, lambda df: decontaminate.clean(df, bench)):
        for df in (odd, copies):
            got = form(df)
            assert got.columns == df.columns
            assert {tuple(r)[2:] for r in got.collect()} <= {tuple(r)[2:] for r in df.collect()}
        assert form(empty).count() == 0


def test_pipeline(spark, documents, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packed":
            assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect() if name != "packed"}
    good = {d: t for d, t in documents.items() if not (base_quality(t)[0] < 10 or 100 * base_quality(t)[4] > 20 * base_quality(t)[0])}
    assert kept["quality_rules"] == good
    assert set(kept["near_duplicates"]) == {low for _, _, low in brute(list(good.items()))}
    assert all(not base_pii(t) for t in kept["personal_data"].values()) and set(kept["personal_data"]) == set(kept["benchmark_leaks"])
    assert {r.doc_id for r in docs.collect()} == set(kept["personal_data"])
