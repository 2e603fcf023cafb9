"""License scan: ordered signature rules over a text's words, gated by keywords, overlaps resolved by priority."""

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that separate words once A-Z are lowered: all of ASCII but digits and a-z.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
#: Phrases whose every place is reported, and their labels.
BASE = {b"cc by": "cc-by", b"general public license": "gpl", b"all rights reserved": "reserved"}


@dataclass(frozen=True)
class Rule:
    """A label for the words that `pattern` matches; looked for only in texts that have one of the words `gate`, of
    which every match holds one. A higher priority wins over lower ones inside it; `weight` is how sure the label is,
    from 0 to 1."""

    label: str
    pattern: re.Pattern
    gate: frozenset[bytes]
    priority: int
    weight: float


# A signature: label, gate words, priority, weight, pattern. Patterns see lowered words with one space between them
# and are held between word boundaries. What a pattern matches must hold a gate word, alone or with a version.
# The order is that of the families; within a family the most exact come first.
_V = r"(?: version)?(?: v)? ?"
SIGNATURES: list[tuple[str, str, int, float, str]] = []


def _family(gate: str, *signatures: tuple[str, int, float, str]) -> None:
    SIGNATURES.extend((label, gate, priority, weight, pattern) for label, priority, weight, pattern in signatures)


_family(
    "apache",
    ("apache-2.0", 90, 1.0, r"licensed under the apache license version 2 0"),
    ("apache-2.0", 85, 0.95, rf"apache (?:software )?license{_V}2(?: 0)?"),
    ("apache-2.0", 80, 0.9, r"(?:spdx license identifier )apache 2 0"),
    ("apache-2.0", 70, 0.8, r"apache 2 0(?: license)?"),
    ("apache-2.0", 60, 0.8, r"www apache org licenses license 2 0"),
    ("apache-1.1", 85, 0.95, rf"apache (?:software )?license{_V}1 1"),
    ("apache-1.0", 85, 0.95, rf"apache (?:software )?license{_V}1 0"),
    ("apache", 20, 0.6, r"apache (?:software )?licen[sc]ed?"),
)
for _number, _words in {"1": "1(?: 0)?", "2": "2(?: 0)?", "3": "3(?: 0)?"}.items():
    _family(
        "general gpl",
        (f"gpl-{_number}.0-or-later", 92, 1.0, rf"gnu general public license(?: as published by the free software foundation)?(?: either)?{_V}{_words}(?: of the license)? or (?:\(?at your option\)? )?any later version"),
        (f"gpl-{_number}.0-or-later", 88, 0.9, rf"gpl ?v? ?{_words} or later"),
        (f"gpl-{_number}.0-only", 86, 0.95, rf"gpl ?v? ?{_words} only"),
        (f"gpl-{_number}.0", 84, 0.95, rf"(?:gnu )?general public licen[sc]e{_V}{_words}"),
        (f"gpl-{_number}.0", 70, 0.85, rf"gnu gpl{_V}{_words}"),
        (f"gpl-{_number}.0", 66, 0.8, rf"gpl ?v? ?{_words}"),
    )
_family(
    "general gpl",
    ("gpl", 30, 0.7, r"gnu general public licen[sc]e"),
    ("gpl", 25, 0.6, r"(?:gnu )?gpl licen[sc]e"),
    ("gpl", 24, 0.6, r"(?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl"),
)
for _number, _words in {"2.0": "2(?: 0)?", "2.1": "2 1", "3.0": "3(?: 0)?"}.items():
    _family(
        "lesser library lgpl",
        (f"lgpl-{_number}-or-later", 93, 1.0, rf"(?:lesser|library) general public license{_V}{_words} or (?:at your option )?any later version"),
        (f"lgpl-{_number}", 89, 0.95, rf"(?:gnu )?(?:lesser|library) general public licen[sc]e{_V}{_words}"),
        (f"lgpl-{_number}", 72, 0.85, rf"lgpl ?v? ?{_words}"),
    )
_family(
    "lesser library lgpl",
    ("lgpl", 40, 0.8, r"(?:gnu )?(?:lesser|library) general public licen[sc]e"),
    ("lgpl", 28, 0.6, r"(?:gnu )?lgpl(?: licen[sc]e)?"),
)
for _number, _words in {"1.0": "1(?: 0)?", "3.0": "3(?: 0)?"}.items():
    _family(
        "affero agpl",
        (f"agpl-{_number}-or-later", 93, 1.0, rf"affero general public license{_V}{_words} or (?:at your option )?any later version"),
        (f"agpl-{_number}", 89, 0.95, rf"(?:gnu )?affero general public licen[sc]e{_V}{_words}"),
        (f"agpl-{_number}", 72, 0.85, rf"agpl ?v? ?{_words}"),
    )
_family(
    "affero agpl",
    ("agpl", 40, 0.8, r"(?:gnu )?affero (?:general public )?licen[sc]e"),
    ("agpl", 28, 0.6, r"(?:gnu )?agpl(?: licen[sc]e)?"),
)
for _kind, _long in {
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?",
    "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc": "attribution non ?commercial",
    "by-nd": "attribution no ?deriv(?:ative)?s?(?: works)?",
    "by-sa": "attribution share ?alike",
    "by": "attribution",
}.items():
    _short = _kind.replace("-", " ")
    # More terms make a longer and more exact name.
    _rank = 60 + 5 * _kind.count("-")
    for _number in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _words = _number.replace(".", " ")
        _family(
            "cc creative creativecommons",
            (f"cc-{_kind}-{_number}", _rank + 20, 1.0, rf"creative commons {_long}{_V}{_words}(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?"),
            (f"cc-{_kind}-{_number}", _rank + 15, 0.95, rf"cc {_short} {_words}"),
            (f"cc-{_kind}-{_number}", _rank + 10, 0.9, rf"creativecommons org licenses {_short} {_words}"),
        )
    _family(
        "cc creative creativecommons",
        (f"cc-{_kind}", _rank, 0.85, rf"creative commons {_long}(?: licen[sc]e)?"),
        (f"cc-{_kind}", _rank - 5, 0.7, rf"cc {_short}"),
    )
_family(
    "cc0 cc creative",
    ("cc0-1.0", 85, 1.0, r"creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", 70, 0.9, r"cc0(?: 1 0)?"),
    ("cc0-1.0", 70, 0.9, r"cc zero(?: 1 0)?"),
    ("creative-commons", 15, 0.5, r"creative commons(?: licen[sc]e)?"),
)
_family(
    "mit",
    ("mit", 80, 1.0, r"(?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?mit licen[sc]e"),
    ("mit", 60, 0.9, r"(?:the )?mit licen[sc]e"),
    ("mit", 60, 0.9, r"spdx license identifier mit"),
)
_family(
    "permission",
    ("mit", 75, 0.95, r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", 75, 0.95, r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee"),
)
_family("isc", ("isc", 60, 0.9, r"(?:the )?isc licen[sc]e"))
for _number, _word, _name in ((0, "zero", "0"), (2, "two", "simplified"), (3, "three", "new|modified|revised"), (4, "four", "original")):
    _family(
        "bsd",
        (f"bsd-{_number}-clause", 82, 0.95, rf"bsd (?:{_number}|{_word}) clause(?: licen[sc]e)?"),
        (f"bsd-{_number}-clause", 82, 0.95, rf"(?:{_number}|{_word}) clause bsd(?: licen[sc]e)?"),
        (f"bsd-{_number}-clause", 70, 0.85, rf"(?:{_name}) bsd licen[sc]e"),
    )
_family(
    "bsd redistribution",
    ("bsd", 65, 0.9, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 30, 0.7, r"(?:the )?bsd (?:style )?licen[sc]e"),
)
for _number in ("1.0", "1.1", "2.0"):
    _words = _number.replace(".", " ").replace(" 0", "(?: 0)?")
    _family(
        "mozilla mpl",
        (f"mpl-{_number}", 85, 0.95, rf"mozilla public licen[sc]e{_V}{_words}"),
        (f"mpl-{_number}", 70, 0.85, rf"mpl ?v? ?{_words}"),
    )
_family("mozilla", ("mpl", 30, 0.7, r"mozilla public licen[sc]e"))
# Licenses known by one long name with versions: label, gate, name, versions.
for _label, _gate, _name, _numbers in (
    ("epl", "eclipse epl", "(?:eclipse public licen[sc]e|epl)", ("1.0", "2.0")),
    ("cddl", "cddl development", "(?:common development and distribution licen[sc]e|cddl)", ("1.0", "1.1")),
    ("cpl", "common cpl", "(?:common public licen[sc]e|cpl)", ("1.0",)),
    ("artistic", "artistic", "(?:the )?artistic licen[sc]e", ("1.0", "2.0")),
    ("bsl", "boost bsl", "(?:boost software licen[sc]e|bsl)", ("1.0",)),
    ("busl", "business busl", "(?:business source licen[sc]e|busl)", ("1.1",)),
    ("eupl", "eupl union", "(?:european union public licen[sc]e|eupl)", ("1.0", "1.1", "1.2")),
    ("osl", "osl open", "(?:open software licen[sc]e|osl)", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "academic afl", "(?:academic free licen[sc]e|afl)", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("gfdl", "documentation gfdl", "(?:gnu )?(?:free documentation licen[sc]e|gfdl)", ("1.1", "1.2", "1.3")),
    ("ofl", "ofl font", "(?:sil )?(?:open font licen[sc]e|ofl)", ("1.0", "1.1")),
    ("apsl", "apple apsl", "(?:apple public source licen[sc]e|apsl)", ("1.0", "1.1", "1.2", "2.0")),
    ("lppl", "latex lppl", "(?:latex project public licen[sc]e|lppl)", ("1.0", "1.1", "1.2", "1.3")),
    ("odbl", "odbl database", "(?:open (?:data commons )?(?:open )?database licen[sc]e|odbl)", ("1.0",)),
    ("odc-by", "odc commons", "(?:open data commons attribution licen[sc]e|odc by)", ("1.0",)),
    ("python", "python", "python (?:software foundation )?licen[sc]e", ("2.0",)),
    ("php", "php", "php licen[sc]e", ("3.0", "3.01")),
    ("zpl", "zope zpl", "(?:zope public licen[sc]e|zpl)", ("1.1", "2.0", "2.1")),
    ("cecill", "cecill", "cecill(?: licen[sc]e)?", ("1.0", "1.1", "2.0", "2.1")),
    ("sspl", "server sspl", "(?:server side public licen[sc]e|sspl)", ("1.0",)),
    ("elastic", "elastic", "elastic licen[sc]e", ("1.0", "2.0")),
    ("ms-pl", "microsoft ms", "(?:microsoft public licen[sc]e|ms pl)", ()),
    ("ms-rl", "microsoft ms", "(?:microsoft reciprocal licen[sc]e|ms rl)", ()),
    ("zlib", "zlib", "(?:the )?zlib(?: libpng)? licen[sc]e", ()),
    ("unlicense", "unlicense", "(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", "(?:the )?wtfpl(?: licen[sc]e)?", ()),
    ("postgresql", "postgresql", "postgresql licen[sc]e", ()),
    ("openssl", "openssl", "openssl licen[sc]e", ()),
    ("x11", "x11", "x11 licen[sc]e", ()),
    ("ncsa", "ncsa illinois", "(?:university of illinois )?ncsa (?:open source )?licen[sc]e", ()),
    ("w3c", "w3c", "w3c (?:software )?(?:notice and )?licen[sc]e", ()),
    ("ruby", "ruby", "ruby licen[sc]e", ()),
    ("vim", "vim", "vim licen[sc]e", ()),
    ("ijg", "jpeg ijg", "(?:independent jpeg group|ijg) licen[sc]e", ()),
    ("openrail", "openrail rail", "(?:creativeml |bigcode )?(?:open )?rail(?: m)?(?: \\w+)? licen[sc]e", ()),
):
    for _number in _numbers:
        _words = _number.replace(".", " ").replace(" 0", "(?: 0)?") if _number.endswith(".0") else _number.replace(".", " ")
        _family(_gate, (f"{_label}-{_number}", 85, 0.95, rf"{_name}{_V}{_words}"))
    _family(_gate, (_label, 45 if not _numbers else 30, 0.8, _name if "licen" in _name or not _numbers else rf"{_name} licen[sc]e"))
_family(
    "public domain",
    ("public-domain", 60, 0.8, r"(?:released|placed|dedicated) (?:in)?to the public domain"),
    ("public-domain", 40, 0.7, r"(?:is|are) in the public domain"),
)
_family("proprietary", ("proprietary", 70, 0.9, r"(?:confidential and proprietary|proprietary and confidential)"))
_family(
    "reserved copyright",
    ("proprietary", 65, 0.9, r"copyright(?: c)? \d{4}(?: \d{4})?(?: \S+){1,8} all rights reserved"),
    ("proprietary", 35, 0.7, r"all rights reserved"),
    ("copyright", 12, 0.4, r"copyright(?: c)? (?:by )?\d{4}(?: \d{4})?"),
)
_family("reproduced", ("proprietary", 34, 0.7, r"no part of this (?:publication|document|work|book) may be reproduced"))
_family("copyrighted", ("copyright", 10, 0.3, r"copyrighted (?:material|work|content)"))
_family(
    "proprietary confidential",
    ("proprietary", 70, 0.9, r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", 50, 0.8, r"proprietary licen[sc]e"),
)


def _openers(gate: str) -> frozenset[bytes]:
    """The words of a gate, each also in one word with what follows it in a short name: lgplv, lgpl3, lgplv3."""
    tails = ["", "v", *(v + str(digit) for v in ("", "v") for digit in range(10))]
    return frozenset((word + tail).encode() for word in gate.split() for tail in tails)


def compiled() -> list[Rule]:
    """The rules by falling priority; rules of one priority keep the order they are written in."""
    rules = [
        Rule(label, re.compile(rb"(?<!\S)(?:" + pattern.encode() + rb")(?!\S)"), _openers(gate), rank, weight)
        for label, gate, rank, weight, pattern in SIGNATURES
    ]
    return sorted(rules, key=lambda rule: -rule.priority)


RULES = compiled()
GATES = frozenset().union(*(rule.gate for rule in RULES))


@dataclass
class Scan:
    """What a text holds: its number of words, starts of base phrases with their labels, and the detections that stay
    as (first word, number of words, label, weight)."""

    n_words: int
    base: list[tuple[int, str]]
    found: list[tuple[int, int, str, float]]


def detections(joined: bytes, present: set[bytes]) -> list[tuple[int, int, Rule]]:
    """Matches (start, end, rule) of the rules whose gate is open. Of overlapping ones the higher priority is looked
    at first, then the longer, then the earlier; a match that lies inside one that stays is suppressed."""
    found = [
        (m.start(), m.end(), rule)
        for rule in RULES if not rule.gate.isdisjoint(present)
        for m in rule.pattern.finditer(joined)
    ]
    found.sort(key=lambda f: (-f[2].priority, f[0] - f[1], f[0]))
    # Spans that stay, by start, with the furthest end up to each: a span is contained if a span that starts no later
    # ends no earlier.
    starts: list[int] = []
    ends: list[int] = []
    stay = []
    for start, end, rule in found:
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        starts.insert(at, start)
        ends.insert(at, max(end, ends[at - 1] if at else 0))
        for i in range(at + 1, len(ends)):
            if ends[i] >= end:
                break
            ends[i] = end
        stay.append((start, end, rule))
    return sorted(stay, key=lambda f: f[:2])


def scan(text: str) -> Scan:
    words = text.encode().translate(_FOLD).split()
    present = GATES.intersection(words)
    if not present:
        return Scan(len(words), [], [])
    joined = b" ".join(words)
    base = [
        (m.start(), label)
        for phrase, label in BASE.items()
        for m in re.finditer(rb"(?<!\S)(?=" + phrase + rb"(?!\S))", joined)
    ]
    found = detections(joined, present)
    if not base and not found:
        return Scan(len(words), [], [])
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    word = lambda at: int(np.searchsorted(blanks, at))
    base = [(word(at), label) for at, label in base]
    found = [(word(start), word(end) - word(start) + 1, rule.label, rule.weight) for start, end, rule in found]
    return Scan(len(words), sorted(base), found)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of ASCII letters (lowered), digits and characters beyond ASCII. `base_labels` are those of the
    phrases in BASE, whose every place counts; `labels` adds those of the detections that stay; `spans` are these
    detections (first word, number of words, label). `score` is the highest weight of a detection, 0 without any.
    Null and empty texts have no words. Equal texts get equal answers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(text) for text in batch["text"].to_pylist()]
            first = [s.base[0][0] if s.base else None for s in found]
            last = [s.base[-1][0] if s.base else None for s in found]
            base = [sorted({label for _, label in s.base}) for s in found]
            labels = [sorted({*own, *(x[2] for x in s.found)}) for own, s in zip(base, found)]
            spans = [[{"first": a, "n": n, "label": x} for a, n, x, _ in s.found] for s in found]
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"],
                    "n_words": pa.array([s.n_words for s in found], pa.int64()),
                    "n_base": pa.array([len(s.base) for s in found], pa.int64()),
                    "first_word": pa.array(first, pa.int64()),
                    "last_word": pa.array(last, pa.int64()),
                    "base_labels": pa.array([",".join(x) for x in base], pa.string()),
                    "labels": pa.array([",".join(x) for x in labels], pa.string()),
                    "score": pa.array([max([w for *_, w in s.found], default=0.0) for s in found], pa.float64()),
                    "spans": pa.array(
                        spans, pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64()), ("label", pa.string())]))
                    ),
                }
            )

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<first: long, n: long, label: string>>",
    )
