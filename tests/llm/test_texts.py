"""Scans, rules, spans, matches and scores against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, duck

import __spark_entry__ as entry
from samples import ODD, SF, WORDS
from stratalens.llm import decontaminate, licences, linkgraph, pii, pulearn, quality, sentences
from stratalens.llm.pieces import grouped

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    places = [(i, label) for phrase, label in licences.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_licences(spark, documents, odd, empty):
    got = entry.queries()["op3_licence_scan"](spark, SF).collect()
    assert {r.doc_id: tuple(r[1:6]) for r in got} == {d: base_licences(t) for d, t in documents.items()}
    assert sorted(tuple(r[1:6]) for r in licences.scan(odd).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").na.fill(-1).collect()) == sorted(
        tuple(-1 if x is None else x for x in base_licences(t)) for _, t, _ in ODD)
    assert licences.scan(empty).count() == 0


@pytest.mark.parametrize(("text", "postfix", "value", "labels"), [
    ("MIT OR GPL-2.0 AND Apache-2.0", ["MIT", "GPL-2.0", "Apache-2.0", "AND", "OR"], 1.0, {"mit", "gpl", "apache"}),
    ("(MIT or GPL-2.0) and Apache-2.0", ["MIT", "GPL-2.0", "OR", "Apache-2.0", "AND"], 1.0, {"mit", "gpl", "apache"}),
    ("GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0-only", "Classpath-exception-2.0", "WITH"], 0.5, {"gpl"}),
    ("MIT AND CC-BY-NC-4.0 */ more words", ["MIT", "CC-BY-NC-4.0", "AND"], 0.1, {"mit", "cc-by-nc"}),
    ("MIT AND", ["MIT"], 1.0, {"mit"}), ("((MIT)", ["MIT"], 1.0, {"mit"}), (") MIT", [], None, set()), ("", [], None, set()), ("Unknown-1.0", ["Unknown-1.0"], None, set()),
    ("MIT OR (", ["MIT"], 1.0, {"mit"}), ("MIT AND (Apache-2.0 OR", ["MIT", "Apache-2.0", "AND"], 1.0, {"mit", "apache"}),
    ("MITRE-1.0", ["MITRE-1.0"], None, set()), ("ISCL", ["ISCL"], None, set()), ("MIT AND LicenseRef-Secret", ["MIT", "LicenseRef-Secret", "AND"], None, {"mit"}),
    ("gpl-3.0-OR-LATER or LicenseRef-Secret", ["gpl-3.0-OR-LATER", "LicenseRef-Secret", "OR"], 0.3, {"gpl"}), ("GPL-2.0+ WITH My-exception", ["GPL-2.0+", "My-exception", "WITH"], 0.3, {"gpl"}),
    ("LGPL-2.1-only AND BSD-3-Clause", ["LGPL-2.1-only", "BSD-3-Clause", "AND"], 0.6, {"lgpl", "bsd"})])
def test_expressions(text, postfix, value, labels):
    assert licences.to_postfix(text) == postfix
    assert licences.evaluate(licences.to_postfix(text)) == (value, labels)


def test_tag_with_expression():
    row = licences.Scanner()("// SPDX-License-Identifier: (MIT OR GPL-3.0-only)\nThe MIT License, all rights reserved")
    assert row[4:] == ("mit", "gpl,mit,proprietary", 0.0)


@pytest.mark.parametrize(("text", "labels", "score"), [
    ("é SPDX License Identifier: MIT", "mit", 1.0), ("/* spdx-license-identifier : GPL-2.0 */", "gpl", 0.3), ("SPDX-License-Identifier:\nMIT", "", 0.0),
    ("SPDX-License-Identifier: MIT\nx\nSPDX-License-Identifier: ISC AND LicenseRef-a", "isc,mit", 1.0), ("SPDX-License-Identifier: ISC AND LicenseRef-a", "isc", 0.0), ("SPDX-License-Identifier", "", 0.0), ("no SPDX license identifiers: MIT", "", 0.0)])
def test_expression_where_the_tag_stands(text, labels, score):
    assert licences.Scanner()(text)[5:] == (labels, score)


def base_quality(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, documents, odd, empty):
    got = entry.queries()["op7_quality_rules"](spark, SF).collect()
    assert {r.doc_id: tuple(r[1:6]) for r in got} == {d: base_quality(t) for d, t in documents.items()}
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert sorted(tuple(r[1:6]) for r in quality.judge(odd, "source").collect()) == sorted(base_quality(t) for _, t, _ in ODD)
    assert quality.judge(empty, "source").count() == 0


def test_common_lines(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    rows = [(i, f"{own(i)}\nPage  7 of THE site menu" if i else f"{own(i)}\npage 7 of the site menu", "a") for i in range(8)]
    rows += [(20 + i, "Page 7 of the site menu\nshort words here", "a") for i in range(2)] + [(40, "page 7 of the site menu\n" + own(40), "b")]
    rows += [(60 + i, own(99) + "\n" + own(98), "c") for i in range(9)]  # copies count once
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), "source", least_documents=5, most_removed=0.5).collect()}
    assert [got[i].n_removed_words for i in (0, 1, 7, 40, 60)] == [0, 6, 6, 0, 0]
    assert got[0].kept and got[1].kept and not got[21].kept and got[40].kept and all(got[60 + i].kept for i in range(9))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
    return kind == "email" or (all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else 10 <= len(digits) <= 15)


def base_pii(text):
    found = sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if _passes(k, m[0]))
    return [f"{k}:{a}:{b}" for a, _, k, b in found]


def _same_pii(rows, texts):
    for r in rows:
        base = base_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k + ":") for x in base) for k in PATTERNS)
        assert set(base) <= set(r.spans.split(",")) | {""}


def test_personal_data(spark, documents):
    _same_pii(entry.queries()["op6_personal_data"](spark, SF).collect(), documents)


def test_personal_data_in_odd_texts(spark, empty):
    rng = random.Random(5)
    parts = ["a.b@c.de", "x@y", "é", "@", "+1 (98) 555-4218 ", " ", "4111 1111 1111 1111", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "_", "%", "-", "+", "00", "9", "a", "\n", "()", "a@b.com_x@y.org"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(800)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _same_pii(pii.digest(pii.spans(df)).collect(), dict(rows))
    long = spark.createDataFrame([(1, "1" * 150_000), (2, "a" * 150_000), (3, "a." * 50_000), (4, "1." * 50_000), (5, "+1" + " " * 50_000)], "doc_id long, text string")
    assert pii.digest(pii.spans(long)).count() == 5
    assert pii.spans(empty).count() == 0
    text = spark.createDataFrame([(1, "é a.b@c.de or +1 (986) 555-4218 x"), (2, "plain"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redacted(text).collect()} == {1: "é [EMAIL] or [PHONE] x", 2: "plain", 3: None}


def test_trees_accept_and_refuse(spark):
    """Disguised addresses and national numbers are added; dates, prices, wrong check digits and order numbers without a right one are not."""
    rng = random.Random(11)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    phone = lambda: f"({rng.randint(200, 999)}) 555-{digits(4)}"
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))

    def card(ok):
        start = digits(15)
        total = sum(x - 9 if x > 9 else x for x in (int(c) * (2 - i % 2) for i, c in enumerate(start)))
        return start + str((-total + (0 if ok else 3)) % 10)

    texts, wanted, unwanted = [], {}, {}
    for i in range(1500):
        kind = i % 10
        value, hidden = {0: (f"+1 {phone()}", None), 1: (f"{word()}{rng.choice(['', '.' + word()])}@{word()}.{rng.choice(['com', 'org', 'a.de'])}", None), 2: (f"{digits(2)}.{digits(2)}.1{digits(2)}.{digits(1)}", None), 3: (card(True), None),
                         4: (digits(rng.choice([1, 2, 3, 4, 6, 8])), False), 5: (f"{digits(8)}-{digits(6)}", False), 6: (f"20{digits(2)}-0{digits(1)}-1{digits(1)}", False),
                         7: (f"{digits(2)},{digits(2)}", False), 8: (card(False), False), 9: (f"{digits(4)}.{digits(3)}.{digits(4)}.{digits(3)}", False)}[kind]
        if i % 150 == 0:
            hidden, value = True, phone()
        if i % 150 == 1:
            hidden, value = True, f"{word()} [at] {word()} [dot] org"
        texts.append((i, f"{word()} {rng.choice(['call', 'mail', 'no', word()])} {value} {word()} {word()}"))
        if hidden is not None:
            (wanted if hidden else unwanted)[i] = value
    rows = {r.doc_id: r for r in pii.digest(pii.spans(spark.createDataFrame(texts, "doc_id long, text string"))).collect()}
    assert all(rows[i].n_email + rows[i].n_ip + rows[i].n_card + rows[i].n_phone == 0 for i in wanted)
    assert sum(bool(rows[i].spans) for i in wanted) >= 0.9 * len(wanted)
    assert {rows[i].spans.split(":")[0] for i in wanted if rows[i].spans} == {"email", "phone"}
    # Of the others only numbers that pass the card check by chance may be taken for cards.
    accepted = [re.sub("[^0-9]", "", v) for i, v in unwanted.items() if rows[i].spans]
    assert all(_passes("card", v) for v in accepted) and len(accepted) < 0.02 * len(unwanted)


def test_leaks(spark, documents, odd, empty):
    got = {(r.doc_id, r.item_id) for r in entry.queries()["op2_benchmark_leaks"](spark, SF).collect()}
    plain = lambda t: f" {' '.join(re.findall('[a-z0-9]+', t.lower()))} "
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert got >= {(d, i) for d, t in documents.items() for i, x in items.items() if x in plain(t)}
    benchmark = spark.createDataFrame([(1, "A train leaves Boston with 120 people and after 3 hours it has gone 240 km, how many km did it go in 1 hour if 120 people stay on?"), (2, "too short"), (3, None)],
                                      "item_id long, text string")
    asked = [(1, "So: a train leaves Denver with 90 people and after 5 hours it has gone 600 km, how many km did it go in 2 hours if 90 people stay on?"),
             (2, "So: a train leaves Denver with 90 people and after 5 hours it has gone 600 km, how many km did it go in 2 hours if 77 people stay on?"),
             (3, "A TRAIN LEAVES BOSTON WITH 120 PEOPLE AND AFTER 3 HOURS IT HAS GONE 240 KM"), (4, "Nothing of it. A train leaves. The people stay on.")]
    found = {r.doc_id: r for r in decontaminate.leaks(spark.createDataFrame(asked, "doc_id long, text string"), benchmark).collect()}
    assert set(found) == {1, 3} and not found[1].exact
    assert decontaminate.leaks(odd, benchmark).count() == 0 and decontaminate.leaks(empty, benchmark).count() == 0 and decontaminate.leaks(odd, benchmark.limit(0)).count() == 0


NATALIA = "Natalia sold clips to her friends in April. Natalia sold half as many clips in May."


def _leaks(spark, item, *texts):
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    return {r.doc_id: r for r in decontaminate.leaks(frame(list(enumerate(texts)), "doc_id"), frame([(1, item)], "item_id")).collect()}


def test_leaks_with_names_that_open_sentences(spark):
    found = _leaks(spark, NATALIA, NATALIA.replace("Natalia", "Maria"), NATALIA, NATALIA.replace("Natalia", "Maria", 1).replace("Natalia", "Ben"), "Somebody else sold clips. Nothing of it was sold in May.")
    assert set(found) == {0, 1} and not found[0].exact and found[1].exact
    item = "The shop opens its old doors at noon and closes them at night. The baker then counts all of the bread that is left."
    assert _leaks(spark, item, item.replace("The baker", "A baker"))[0].n_windows >= 5


def test_leaks_word_for_word_beside_inconsistent_slots(spark):
    item = "the old mill by the river grinds 40 sacks of grain while the miller and all of the helpers sing of the long dry summer, and after that the carts bring 40 more sacks of grain up from the lower fields"
    found = _leaks(spark, item, item.replace("bring 40", "bring 55"), item.replace("40", "55"), item)
    assert {d: (r.exact, r.n_windows >= 13) for d, r in found.items()} == {0: (False, True), 1: (False, True), 2: (True, True)}


def test_leaks_with_names_of_other_lengths(spark):
    item = "the boy saw Maria near the old Danube while he drew Vienna and the birds of its long river shores"
    longer = item.replace("Maria", "Mary Ann").replace("Danube", "Rio Grande").replace("Vienna", "New York")
    opening = NATALIA + " Natalia kept all of the rest."
    assert set(_leaks(spark, item, longer, longer.replace("the old", "an odd").replace("drew", "left"))) == {0}
    assert _leaks(spark, opening, opening.replace("Natalia", "Mary Ann Lee"))[0].n_windows >= 10
    assert {d: r.n_places for d, r in _leaks(spark, item, f"{longer}. {longer}", f"{item} {item}".upper()).items()} == {0: 2, 1: 2}


def test_null_ids_are_cleaned_and_redacted(spark):
    rows = [(None, NATALIA), (None, "write to a.b@c.de"), (None, "write to a.b@c.de"), (1, NATALIA), (2, "plain"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, NATALIA)], "item_id long, text string")
    got = pii.redacted(decontaminate.clean(df, items)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (0, "write to [EMAIL]"), (0, "write to [EMAIL]"), (2, "plain")]


def test_repeated_sentences(spark, odd, empty):
    passage = "The first sentence of it has eight words. Then comes another one of nine plain words! And a third sentence ends it all?"
    rows = [(3, f"Own words stand before. {passage} Own words stand behind."), (1, f"Else here. {passage}"), (2, "Nothing that another text has. Not even this here one."), (4, passage.upper().replace("!", "."))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.sentences, r.first_docs) for r in sentences.repeated(df).collect()}
    assert got == {3: ([1, 2, 3], [1]), 4: ([0, 1, 2], [1])}
    assert {r.doc_id: r.text for r in sentences.removed(df).collect()} == {1: rows[1][1], 2: rows[2][1], 3: "Own words stand before. Own words stand behind.", 4: ""}
    assert {r.doc_id for r in sentences.repeated(odd).collect()} <= {5, 6, 7, 8} and sentences.repeated(empty).count() == 0


def test_repeats_against_brute_force(spark, documents):
    seen, want = {}, {}
    for doc in sorted(documents):
        found = sentences.sentences(documents[doc])
        for i in range(len(found)):
            key, words, reach = 0, 0, 0
            for n, (_, _, size, one) in enumerate(found[i:], 1):  # all runs from here
                key, words = hash((key, one)), words + size
                if n >= 2 and words >= 15 and seen.setdefault(key, (doc, i)) != (doc, i):
                    reach = n
            if reach:
                want.setdefault(doc, set()).update(range(i, i + reach))
    assert {r.doc_id: set(r.sentences) for r in entry.queries()["op5_repeated_sentences"](spark, SF).collect()} == want


def test_ends_of_repeated_passages(spark):
    rng = random.Random(3)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) + "."
    pool = [line(rng.choice([2, 5, 7, 13, 20])) for _ in range(60)]
    rows = []
    for d in range(30):
        parts = []
        while len(parts) < 12:
            at = rng.randrange(58)
            parts += pool[at : at + rng.randint(1, 4)] + [line(rng.choice([3, 9, 16]))]
        rows.append((d, " ".join(parts)))
    seen, want = {}, {}
    for d, text in rows:
        found = sentences.sentences(text)
        for i in range(len(found)):
            for j in range(i + 2, len(found) + 1):
                if sum(x[2] for x in found[i:j]) >= 15 and seen.setdefault(tuple(x[3] for x in found[i:j]), (d, i)) != (d, i):
                    want.setdefault(d, set()).update(range(i, j))
    assert {r.doc_id: set(r.sentences) for r in sentences.repeated(spark.createDataFrame(rows, "doc_id long, text string"), ends=True).collect()} == want


def test_repeats_without_blanks(spark):
    passage = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed\u3002\u4ed6\u5728\u90a3\u91cc\u770b\u4e66\u548c\u559d\u8336\uff01"
    rows = [(1, "\u7b2c\u4e00\u7bc7\u3002" + passage), (2, passage + "\u53e6\u4e00\u7bc7\u3002")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in sentences.removed(df).collect()} == {1: rows[0][1], 2: "\u53e6\u4e00\u7bc7\u3002"}


def test_link_verdicts(spark):
    assert compare(entry.queries()["op9_link_verdicts"](spark, SF), duck(SF), entry.oracle_sql()["op9_link_verdicts"]) == ""
    link = lambda h: f'<p><a class="x" href="https://{h}/a">t</a>'
    rows = [(1, "http://Good.org/x", link("b.net")), (2, "http://a.com/de/1", ""), (3, "http://bad.net/q", link("A.com") * 2), (4, "http://b.net/?x=/", link("b.net")), (5, None, None), (6, "no scheme", ""),
            (7, "x://EXAMPLE.org:80/es/", ""), (8, "http://s.example.org/en/12#f", ""), (9, "http://example.org", ""), (9, "http://example.org", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: tuple(r[1:]) for r in linkgraph.judge(df).collect()}
    assert got == {1: ("good.org", "/x", "org/", "allow"), 2: ("a.com", "/de/1", "com/de/", "block"), 3: ("bad.net", "/q", None, "block"), 4: ("b.net", "/", None, "allow"), 5: ("", "", None, "allow"),
                   6: ("", "", None, "allow"), 7: ("example.org:80", "/es/", None, "allow"), 8: ("s.example.org", "/en/12", "example.org/en/1", "block"), 9: ("example.org", "", None, "allow")}
    assert linkgraph.judge(df.limit(0)).count() == 0


def test_verdicts_at_the_end_of_a_long_chain(spark):
    rows = [(i, f"http://h{i}.net/x", f'<a href="https://{"bad.com" if i == 15 else f"h{i + 1}.net"}/a">t</a>') for i in range(1, 16)] + [(16, "http://bad.com/de/1", ""), (17, "http://other.net/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in linkgraph.judge(df).collect()} == {i: "block" for i in range(1, 17)} | {17: "allow"}


def test_verdicts_against_a_solved_walk(spark):
    """Linked hosts, both walks as linear equations with the mass of hosts without links returned to the seeds."""
    rng = random.Random(3)
    hosts = [f"h{i}.net" for i in range(30)] + [f"t{i}.org" for i in range(4)] + [f"d{i}.com" for i in range(4)]
    pages = []
    for host in hosts:
        for _ in range(rng.randint(1, 5) * (9 if host == "t0.org" else 1)):
            links = rng.sample(hosts, rng.choice([0, 0, 1, 2, 3]))
            pages.append((len(pages), f"http://{host}/{'de/' if host.endswith('.com') else ''}x", "".join(f'<a href="https://{x}/a">t</a>' for x in links)))
    got = {r.page_id: (r.rule, r.verdict) for r in linkgraph.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    index, n = {h: i for i, h in enumerate(hosts)}, len(hosts)
    count, seeds = np.zeros((n, n)), np.zeros((2, n))
    for page, url, html in pages:
        host = linkgraph_host(url)
        for x in set(re.findall("https://([^/]+)", html)) - {host}:
            count[index[host], index[x]] += 1
        if host.endswith(".org"):
            seeds[0, index[host]] += 1
        if host.endswith(".com"):
            seeds[1, index[host]] += 1

    def walk(links, seed):
        seed, out = seed / seed.sum(), links.sum(1, keepdims=True)
        step = np.where(out > 0, links / np.maximum(out, 1), seed)
        return np.linalg.solve(np.eye(n) - 0.85 * step.T, 0.15 * seed)

    trust, distrust = walk(count, seeds[0]), walk(count.T, seeds[1])
    assert len(set(got.values())) > 3
    for page, url, _ in pages:
        i = index[linkgraph_host(url)]
        if got[page][0] is None:
            assert got[page][1] == ("block" if distrust[i] > trust[i] else "allow")


def linkgraph_host(url):
    return url.split("/")[2]


def test_verdicts_do_not_depend_on_the_number_of_seed_pages(spark):
    """A host between a trusted and a blocked one: a hundred pages on either side weigh as one does."""
    verdicts = set()
    for trusted, blocked in ((1, 1), (100, 1), (1, 10)):
        rows = [(i, "http://good.org/x", '<a href="http://m.net/">m</a>') for i in range(trusted)] + [(200 + i, "http://bad.com/de/1", "") for i in range(blocked)] + [(500, "http://m.net/q", '<a href="http://bad.com/">b</a>')]
        verdicts.add({r.page_id: r.verdict for r in linkgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}[500])
    assert len(verdicts) == 1


def test_quality_scores(spark, odd, empty):
    folder = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = entry.queries()["op10_positive_unlabelled"](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pairs = [(a > b) + (a == b) / 2 for a, x in held if x for b, y in held if not y]
    assert sum(pairs) / len(pairs) > 0.95
    known = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (6, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert pulearn.score(odd, known).count() == len(ODD)
    assert {r.score for r in pulearn.score(odd, known.limit(0)).collect()} == {0.5}
    assert pulearn.score(empty, known).count() == 0


def test_windows_work_out_words_when_asked():
    """A text none of whose windows is in question pays for hashes only; places and words are the same when asked for."""
    w = decontaminate.Windows("The train left Paris at 9 and reached Old Rome after 14 hours. Anna took 3 bags, two hats and one map with her.", 8, 5)
    assert len(w.hashes) and not {"words", "_places"} & set(vars(w))
    i = int(w.levels.argmax())
    assert w.places(i) and "words" not in vars(w) and w.values(i) and w.words[:4] == ["The", "train", "left", "Paris"]


def test_windows_of_texts_in_a_row():
    """Many texts at a time have the windows of each alone, with words, places and values, and none across texts."""
    rng = random.Random(5)
    pool = ["the", "of", "Old", "Rome", "Anna", "3", "km", "two", "hours", "a.", "Is!", 'end."', "\n", "\x00", "—", "é", "Éa", "x\u00a0y", "\x1c", "\u3000", "A\nB", "it's", "and", "with", "river", "mill", "long", "sings"]
    texts = [None if k % 20 == 3 else " ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 7, 8, 9, 30]))) for k in range(300)]
    ((buffer, bounds),) = grouped(pa.array(texts, pa.string()))
    facts = lambda w, i: (int(w.hashes[i]), w.place(i)[1], w.values(i), int(w.levels[i]), w.places(i), w.inside(i))
    alone = [(k, *facts(w, i)) for k, t in enumerate(texts) for w in [decontaminate.Windows(t or "", 8, 5)] for i in range(len(w.hashes))]
    row = decontaminate.Windows((buffer, bounds), 8, 5)
    assert len(alone) > 500 and sorted((row.place(i)[0], *facts(row, i)) for i in range(len(row.hashes))) == sorted(alone)
    assert row.words == [x for t in texts for x in (t or "").split() if re.sub(r"[\W_]", "", x)]
