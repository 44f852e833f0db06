"""Licence notices and SPDX expressions in texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Phrases of the base scan with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Further notice phrases and identifiers with their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl",
    "eclipse public license": "epl", "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd", "isc license": "isc",
    "creative commons attribution": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc0": "cc0",
    "public domain": "public-domain", "unlicense": "unlicense", "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
# SPDX identifiers, a family with its versions to a line; "" is an identifier without a version.
FAMILIES = {
    "gpl": ("gpl", "1.0 2.0 3.0"), "lgpl": ("lgpl", "2.0 2.1 3.0"), "agpl": ("agpl", "1.0 3.0"), "gfdl": ("gfdl", "1.1 1.2 1.3"),
    "apache": ("apache", "1.0 1.1 2.0"), "mpl": ("mpl", "1.0 1.1 2.0"), "epl": ("epl", "1.0 2.0"), "eupl": ("eupl", "1.0 1.1 1.2"), "cddl": ("cddl", "1.0 1.1"),
    "cc-by": ("cc-by", "1.0 2.0 2.5 3.0 4.0"), "cc-by-sa": ("cc-by-sa", "1.0 2.0 2.5 3.0 4.0"), "cc-by-nd": ("cc-by-nd", "1.0 2.0 2.5 3.0 4.0"),
    "cc-by-nc": ("cc-by-nc", "1.0 2.0 2.5 3.0 4.0"), "cc-by-nc-sa": ("cc-by-nc", "1.0 2.0 2.5 3.0 4.0"), "cc-by-nc-nd": ("cc-by-nc", "1.0 2.0 2.5 3.0 4.0"),
    "cc0": ("cc0", "1.0"), "bsl": ("bsl", "1.0"), "artistic": ("artistic", "1.0 2.0"), "ofl": ("ofl", "1.0 1.1"), "odbl": ("odbl", "1.0"), "pddl": ("public-domain", "1.0"),
    "python": ("python", "2.0"), "psf": ("python", "2.0"), "afl": ("afl", "1.1 1.2 2.0 2.1 3.0"), "osl": ("osl", "1.0 1.1 2.0 2.1 3.0"),
}
SINGLE = {"mit": "mit", "mit-0": "mit", "mit-cmu": "mit", "x11": "mit", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense", "wtfpl": "wtfpl", "postgresql": "postgresql", "ncsa": "ncsa", "ms-pl": "ms-pl",
          "0bsd": "bsd", "bsd-1-clause": "bsd", "bsd-2-clause": "bsd", "bsd-2-clause-patent": "bsd", "bsd-3-clause": "bsd", "bsd-3-clause-clear": "bsd", "bsd-4-clause": "bsd"}
# Families of which a version may also be meant alone or with all later ones.
OR_LATER = {"gpl", "lgpl", "agpl", "gfdl"}
EXCEPTIONS = {"autoconf-exception-2.0", "autoconf-exception-3.0", "bison-exception-2.2", "classpath-exception-2.0", "font-exception-2.0", "gcc-exception-2.0", "gcc-exception-3.1",
              "libtool-exception", "linux-syscall-note", "llvm-exception", "openjdk-assembly-exception-1.0", "qt-gpl-exception-1.0", "wxwindows-exception-3.1"}
IDENTIFIERS = SINGLE | {f"{stem}-{version}{end}": label for stem, (label, versions) in FAMILIES.items() for version in versions.split()
                        for end in ("", "+", *(("-only", "-or-later") if stem in OR_LATER else ()))}
# How freely a text under the licence may be used, from 0 to 1.
FREEDOM = {"mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "cc-by": 0.9, "lgpl": 0.6, "mpl": 0.6, "epl": 0.6,
           "zlib": 1.0, "bsl": 1.0, "wtfpl": 1.0, "postgresql": 1.0, "ncsa": 1.0, "python": 1.0, "afl": 0.9, "artistic": 0.8, "ms-pl": 0.8, "ofl": 0.8,
           "cddl": 0.6, "eupl": 0.4, "osl": 0.3, "odbl": 0.5, "gfdl": 0.4, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nd": 0.1, "cc-by-nc": 0.1, "proprietary": 0.0}
EXCEPTION = 0.2  # what a known exception adds to a licence

_PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_AFTER_TAG = re.compile(rb"[\x20\t]*[:=]?([^\n]*)")
# Bytes outside words become blanks; A-Z become a-z. All bytes of characters beyond ASCII belong to words.
_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def identify(identifier: str) -> str | None:
    """The label of a whole SPDX identifier in any case; None for others, ``LicenseRef-`` ones among them."""
    return IDENTIFIERS.get(identifier.lower())


def to_postfix(text: str) -> list[str]:
    """The licence expression at the start of ``text`` in postfix order (shunting-yard); empty if there is none.

    WITH binds tighter than AND, AND tighter than OR. The expression ends before the first token that cannot follow.
    """
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(text):
        name = token.upper()
        if operand_next:
            if token == "(":
                stack.append(token)
            elif token == ")" or name in _PRECEDENCE:
                break
            else:
                out.append(token)
                operand_next = False
        elif token == ")":
            if "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif name in _PRECEDENCE:
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[name]:
                out.append(stack.pop())
            stack.append(name)
            operand_next = True
        else:
            break
    if operand_next:  # the last operator has no right side, at most opened brackets
        while stack and stack.pop() == "(":
            pass
    return out + [t for t in reversed(stack) if t != "("]


def evaluate(postfix: list[str]) -> tuple[float | None, set[str]]:
    """Freedom of an expression and the known licences in it: the better known side of OR, the worse of AND.

    The freedom is unknown (None) of an unknown identifier and of AND with an unknown side, since that side may forbid
    anything. WITH raises its licence by the worth of an exception if it is a known one.
    """
    stack: list[tuple[float | None, set[str]]] = []
    last = ""
    for token in postfix:
        if token not in _PRECEDENCE:
            label = identify(token)
            stack.append((FREEDOM[label], {label}) if label else (None, set()))
            last = token  # the right side of a WITH that follows
            continue
        if len(stack) < 2:
            return None, set()
        right, left = stack.pop(), stack.pop()
        if token == "WITH":
            raised = left[0] if left[0] is None or last.lower() not in EXCEPTIONS else min(1.0, left[0] + EXCEPTION)
            stack.append((raised, left[1]))
            continue
        known = [x for x in (left[0], right[0]) if x is not None]
        value = max(known, default=None) if token == "OR" else min(known) if len(known) == 2 else None
        stack.append((value, left[1] | right[1]))
    return stack[0] if len(stack) == 1 else (None, set())


class Scanner:
    """An Aho-Corasick automaton over whole words; every phrase has a blank on both sides."""

    def __init__(self) -> None:
        import ahocorasick

        self._machine = ahocorasick.Automaton()
        for phrase, label in (BASE | NOTICES | {TAG: ""}).items():
            self._machine.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
        self._machine.make_automaton()

    def __call__(self, text: str) -> tuple:
        words = text.encode().translate(_WORDS).split()
        if not words:
            return 0, 0, None, None, "", "", 0.0
        line = f" {b' '.join(words).decode('latin-1')} "
        n_base, first, last, tags = 0, None, None, []
        base: set[str] = set()
        labels: set[str] = set()
        for end, (length, label, is_base) in self._machine.iter(line):
            if is_base:
                start = end - length + 1
                first = start if first is None else min(first, start)
                last = start if last is None else max(last, start)
                n_base += 1
                base.add(label)
            if label:
                labels.add(label)
            else:
                tags.append(end - length + 1)
        worth = [FREEDOM[x] for x in labels]
        if tags:
            raw = text.encode()
            ends = [m.end() for m in _WORD.finditer(raw)]
            for start in tags:
                after = _AFTER_TAG.match(raw, ends[line.count(" ", 0, start) + len(TAG.split()) - 1])
                value, names = evaluate(to_postfix(after[1].decode(errors="replace")))
                labels |= names
                worth += [] if value is None else [value]
        place = [None if x is None else line.count(" ", 0, x) for x in (first, last)]
        return len(words), n_base, *place, ",".join(sorted(base)), ",".join(sorted(labels)), min(worth, default=0.0)


_SCANNER: list[Scanner] = []


def scan(df: DataFrame) -> DataFrame:
    """Licence notices of every whole text of ``df`` (doc_id, text), in one pass over the input splits, without a shuffle.

    ``n_base`` counts the places of the base phrases, ``first_word`` and ``last_word`` are the smallest and largest word
    numbers of their starts; ``labels`` also has the other notices and the licences of SPDX expressions. ``score`` is
    the least freedom of all notices and expressions, 0 without any. An expression is what follows a tag on its line, with
    or without a colon. A null or empty text has no words and no labels;
    repeated rows give repeated rows; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        for batch in batches:
            rows = [_SCANNER[0](x.as_py() or "") for x in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_ARROW)[1:], strict=True))], schema=_ARROW)

    return df.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
