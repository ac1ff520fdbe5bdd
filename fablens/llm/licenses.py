"""License scans: ordered signature rules over a text's words.

A text becomes its words (lower case, ASCII letters and digits and anything beyond ASCII) joined by single spaces. Rules are
regular expressions over that string. Those written by hand (`license_rules.py`) are notices, passages of the license texts,
addresses, package classifiers and names; the others come from the families below and templates: identifiers and the
operands of their expressions, license fields, names with versions, and grants. A rule runs only if its keywords occur, which
one Aho-Corasick pass tells. Detections are ordered by priority, then length, then place; one whose words lie within those of an earlier one is
suppressed. The base phrases are found by themselves and are never suppressed.

A "+" at the end of a word that ends in a digit stays on it for the rules: GPL-2.0+ is GPL-2.0 or later. It makes no word.

Defined results: a null text has no words. Rows that repeat an id, or a whole row, are scanned one by one. Other columns are
not looked at. Whole texts are scanned; memory is a batch of rows plus a few times one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablens.llm.common import delimiter_table
from fablens.llm.license_rules import MARKS, NAMES, NOTICES, PASSAGES

BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Families: label, names as they stand in running text, versions (words), keywords of which one must occur.
FAMILIES = (
    ("gpl", r"(?:gnu )?general public licen[sc]e|(?:gnu )?gpl", ("1", "2", "3"), ("general public", "gpl")),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e|(?:gnu )?lgpl", ("2", "2 1", "3"), ("general public", "lgpl")),
    ("agpl", r"(?:gnu )?affero general public licen[sc]e|(?:gnu )?agpl", ("1", "3"), ("affero", "agpl")),
    ("gfdl", r"(?:gnu )?free documentation licen[sc]e|gfdl", ("1 1", "1 2", "1 3"), ("free documentation", "gfdl")),
    ("apache", r"apache(?: software)? licen[sc]e", ("1 0", "1 1", "2 0"), ("apache",)),
    ("mit", r"mit licen[sc]e|expat licen[sc]e", (), ("mit licen", "expat")),
    ("bsd", r"bsd licen[sc]e|berkeley software distribution licen[sc]e", (), ("bsd", "berkeley")),
    ("bsd-2-clause", r"(?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd|freebsd licen[sc]e", (), ("bsd",)),
    ("bsd-3-clause", r"(?:3|three) clause bsd|bsd (?:3|three) clause|(?:new|modified|revised) bsd", (), ("bsd",)),
    ("bsd-4-clause", r"(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd", (), ("bsd",)),
    ("isc", r"isc licen[sc]e", (), ("isc licen",)),
    ("mpl", r"mozilla public licen[sc]e|mpl", ("1 0", "1 1", "2 0"), ("mozilla", "mpl")),
    ("epl", r"eclipse public licen[sc]e|epl", ("1 0", "2 0"), ("eclipse", "epl")),
    ("cpl", r"common public licen[sc]e", ("1 0",), ("common public",)),
    ("ipl", r"ibm public licen[sc]e", ("1 0",), ("ibm public",)),
    ("cddl", r"common development and distribution licen[sc]e|cddl", ("1 0", "1 1"), ("common development", "cddl")),
    ("eupl", r"european union public licen[sc]e|eupl", ("1 0", "1 1", "1 2"), ("european union public", "eupl")),
    ("osl", r"open software licen[sc]e", ("1 0", "2 0", "2 1", "3 0"), ("open software licen",)),
    ("afl", r"academic free licen[sc]e", ("1 1", "2 0", "2 1", "3 0"), ("academic free",)),
    ("artistic", r"artistic licen[sc]e", ("1 0", "2 0"), ("artistic",)),
    ("boost", r"boost software licen[sc]e", ("1 0",), ("boost software",)),
    ("zlib", r"zlib(?: libpng)? licen[sc]e", (), ("zlib",)),
    ("cc-by", r"creative commons attribution|cc by", ("1 0", "2 0", "2 5", "3 0", "4 0"), ("creative commons", "cc by")),
    ("cc-by-sa", r"creative commons attribution share ?alike|cc by sa", ("1 0", "2 0", "2 5", "3 0", "4 0"), ("creative commons", "cc by")),
    ("cc-by-nc", r"creative commons attribution non ?commercial|cc by nc", ("1 0", "2 0", "2 5", "3 0", "4 0"), ("creative commons", "cc by")),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:ative)?s|cc by nd", ("1 0", "2 0", "2 5", "3 0", "4 0"), ("creative commons", "cc by")),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike|cc by nc sa", ("2 0", "2 5", "3 0", "4 0"), ("creative commons", "cc by")),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd", ("2 0", "2 5", "3 0", "4 0"), ("creative commons", "cc by")),
    ("cc0", r"cc0|creative commons zero", ("1 0",), ("cc0", "creative commons")),
    ("unlicense", r"the unlicense", (), ("unlicense",)),
    ("wtfpl", r"wtfpl|do what the fuck you want to public licen[sc]e", ("1", "2"), ("wtfpl", "fuck")),
    ("ofl", r"(?:sil )?open font licen[sc]e", ("1 0", "1 1"), ("open font",)),
    ("psf", r"python software foundation licen[sc]e|psf licen[sc]e", ("2",), ("python software", "psf")),
    ("openssl", r"openssl licen[sc]e", (), ("openssl",)),
    ("ms-pl", r"microsoft public licen[sc]e", (), ("microsoft public",)),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", (), ("microsoft reciprocal",)),
    ("postgresql", r"postgresql licen[sc]e", (), ("postgresql",)),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e", (), ("ncsa",)),
    ("x11", r"x11 licen[sc]e", (), ("x11",)),
    ("ecl", r"educational community licen[sc]e", ("1 0", "2 0"), ("educational community",)),
    ("zpl", r"zope public licen[sc]e", ("2 0", "2 1"), ("zope",)),
    ("php", r"php licen[sc]e", ("3 0", "3 01"), ("php licen",)),
    ("ruby", r"ruby licen[sc]e", (), ("ruby licen",)),
    ("vim", r"vim licen[sc]e", (), ("vim licen",)),
    ("odbl", r"open (?:data commons open )?database licen[sc]e|odbl", ("1 0",), ("database licen", "odbl")),
    ("pddl", r"public domain dedication and licen[sc]e|pddl", ("1 0",), ("public domain", "pddl")),
    ("qpl", r"q public licen[sc]e", ("1 0",), ("q public",)),
    ("sleepycat", r"sleepycat licen[sc]e", (), ("sleepycat",)),
    ("w3c", r"w3c software (?:notice and )?licen[sc]e", (), ("w3c",)),
    ("upl", r"universal permissive licen[sc]e", ("1 0",), ("universal permissive",)),
    ("sspl", r"server side public licen[sc]e", ("1",), ("server side public",)),
    ("busl", r"business source licen[sc]e", ("1 0", "1 1"), ("business source",)),
)

# Sentences of the license texts and notices: label, pattern, keyword.
SENTENCES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby granted"),
    ("isc", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee", "with or without fee"),
    ("bsd", r"redistribution and use in source and binary forms", "source and binary"),
    ("bsd-3-clause", r"neither the name of .{1,80}? nor the names of its contributors", "neither the name"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software", "advertising materials"),
    ("apache-2.0", r"you may not use this file except in compliance with the license", "in compliance with"),
    ("gpl", r"this program is free software you can redistribute it and or modify it", "redistribute it"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it", "redistribute it"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license", "source code form"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event", "express or implied"),
    ("boost-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy", "hereby granted"),
    ("public-domain", r"(?:released|dedicated|placed) (?:in|into|to) the public domain", "public domain"),
    ("proprietary", r"all rights reserved", "all rights reserved"),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", "copyright"),
)
# Priority and confidence of each template.
IDENTIFIER, OPERAND, VERSIONED, SENTENCE, GRANT, NAME = (5, 1.0), (5, 0.9), (4, 0.95), (3, 0.9), (2, 0.8), (1, 0.6)
BASE_CONFIDENCE = 0.6
_WORDS = delimiter_table(bytes(c for c in range(128) if not chr(c).isalnum() and chr(c) != "+"))
_NO_MARK = re.compile(rb"(?<![0-9])\+|\+(?=[^ ])")


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    keywords: frozenset[str]
    priority: int
    confidence: float
    also: str = ""  # a keyword that must occur besides


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    found = []

    def add(label, pattern, keywords, kind, also=""):
        whole = re.compile(rb"(?:(?<= )|^)(?:" + pattern.encode() + rb")(?=[ +]|$)")
        found.append(Rule(label, whole, frozenset(keywords), *kind, also))

    for label, names, versions, keywords in FAMILIES:
        spoken = label.replace("-", " ")
        # An identifier or the field of a manifest or header, and a later operand of an identifier's expression.
        field, operand = ("spdx", f"license {spoken}", f"licence {spoken}"), (f"or {spoken}", f"and {spoken}")
        stated = rf"(?:spdx license identifier|licen[sc]e) {spoken}"
        add(label, stated, field, IDENTIFIER)
        add(label, rf"(?:or|and) {spoken}", operand, OPERAND, "spdx")
        add(label, rf"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:{names})", keywords, GRANT)
        add(label, names, keywords, NAME)
        for version in versions:
            dotted, short = version.replace(" ", "."), re.sub(r" 0$", "(?: 0)?", version)
            if " " not in version:
                version = short = rf"{version}(?: 0)?"
            # The version stands behind a space or a v, also as one word with the name: gpl 3, gpl v3, gplv3.
            named = rf"(?:{names})(?: licen[sc]e)?(?: international| unported)?(?: version| v|v)? ?{short}"
            more = r"(?:\+| or later)"
            later = r"(?:\+| (?:or (?:\(?at your option\)? )?(?:any )?|and (?:\(?at your option\)? )?any )later(?: version)?)"
            add(f"{label}-{dotted}", rf"{stated} {version}(?: only)?", field, IDENTIFIER)
            add(f"{label}-{dotted}-or-later", rf"{stated} {version}{more}", field, IDENTIFIER)
            add(f"{label}-{dotted}", rf"(?:or|and) {spoken} {version}(?: only)?", operand, OPERAND, "spdx")
            add(f"{label}-{dotted}-or-later", rf"(?:or|and) {spoken} {version}{more}", operand, OPERAND, "spdx")
            add(f"{label}-{dotted}", named, keywords, VERSIONED)
            add(f"{label}-{dotted}-or-later", named + later, keywords, VERSIONED)
    for label, pattern, keyword in SENTENCES:
        add(label, pattern, (keyword,), SENTENCE)
    for table, kind in ((NOTICES, VERSIONED), (PASSAGES, SENTENCE), (MARKS, IDENTIFIER), (NAMES, NAME)):
        for label, keyword, pattern in table:
            add(label, pattern, (keyword,), kind)
    return tuple(found)


@lru_cache(maxsize=1)
def _keywords():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word in {k for rule in rules() for k in rule.keywords} | {phrase for phrase, _ in BASE}:
        automaton.add_word(word, word)
    automaton.add_word("spdx", "spdx")
    automaton.make_automaton()
    return automaton


def _word_places(words: bytes, starts: list[int]) -> dict[int, int]:
    """Number of the word that begins at each byte place."""
    found, at, number = {}, 0, 0
    for start in sorted(set(starts)):
        number += words.count(b" ", at, start)
        found[start], at = number, start
    return found


def _uncontained(raw: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Detections (start, end, rule) that do not lie within one of higher priority, or of the same one and longer.

    Of detections with the same place and priority the first rule's stays. All of one priority and length are settled at
    once, against the furthest end that the ones kept so far reach from any start up to theirs.
    """
    groups: dict[tuple[int, int], dict[int, int]] = {}
    for start, end, number in raw:
        first = groups.setdefault((-rules()[number].priority, start - end), {})
        first[start] = min(number, first.get(start, number))
    kept: list[tuple[int, int, int]] = []
    starts, reach = np.empty(0, np.int64), np.empty(0, np.int64)
    for (_, length), first in sorted(groups.items()):
        own = np.array(sorted(first), dtype=np.int64)
        if len(starts):
            before = np.searchsorted(starts, own, side="right") - 1
            own = own[(before < 0) | (reach[np.maximum(before, 0)] < own - length)]
        kept += [(int(a), int(a) - length, first[int(a)]) for a in own]
        ordered = sorted((a, b) for a, b, _ in kept)
        starts = np.array([a for a, _ in ordered], dtype=np.int64)
        reach = np.maximum.accumulate(np.array([b for _, b in ordered], dtype=np.int64)) if ordered else starts
    return kept


def scan(text: str | None) -> dict:
    """n_words, base (list of (word, label)), detections (list of (start, stop, label, priority), in words) and score."""
    marked = (text or "").encode("utf-8", "replace").translate(_WORDS)
    split = _NO_MARK.sub(b" ", marked).split()
    words = b" ".join(split)
    present = {word for _, word in _keywords().iter(words.decode("utf-8", "replace"))}
    base, raw = [], []
    for phrase, label in BASE:
        if phrase not in present:
            continue
        wanted = phrase.encode()
        at = words.find(wanted)
        while at >= 0:
            end = at + len(wanted)
            if (at == 0 or words[at - 1] == 32) and (end == len(words) or words[end] == 32):
                base.append((at, label))
            at = words.find(wanted, at + 1)
    if present:
        for number, rule in enumerate(rules()):
            if rule.keywords & present and (not rule.also or rule.also in present):
                raw += [(m.start(), m.end(), number) for m in rule.pattern.finditer(words)]
    every = rules()
    kept = _uncontained(raw)
    place = _word_places(words, [a for a, _ in base] + [x for a, b, _ in kept for x in (a, b)])
    doubt = 1.0
    best: dict[str, float] = {}
    for _, _, number in kept:
        rule = every[number]
        best[rule.label] = max(rule.confidence, best.get(rule.label, 0.0))
    for confidence in best.values():
        doubt *= 1 - confidence
    if base:
        doubt *= 1 - BASE_CONFIDENCE
    return {
        "n_words": len(split),
        "base": sorted((place[a], label) for a, label in base),
        "detections": sorted((place[a], place[b] + 1, every[n].label, every[n].priority) for a, b, n in kept),
        "score": round(1 - doubt, 6),
    }


_KIND = pa.schema([
    ("n_words", pa.int64()),
    ("base", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
    ("detections", pa.list_(pa.struct([
        ("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("priority", pa.int32()),
    ]))),
    ("score", pa.float64()),
])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(first, 512) for b in batches for first in range(0, b.num_rows, 512)):
        rows = []
        for text in batch.column(batch.num_columns - 1):
            found = scan(text.as_py())
            found["base"] = [{"word": w, "label": label} for w, label in found["base"]]
            found["detections"] = [
                {"start": a, "stop": b, "label": label, "priority": p} for a, b, label, p in found["detections"]
            ]
            rows.append(found)
        result = pa.RecordBatch.from_pylist(rows, schema=_KIND)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *result.columns], names=[*batch.schema.names[:-1], *_KIND.names]
        )


def scan_licenses(documents: DataFrame, keep: dict[str, F.Column], text_column: str = "text") -> DataFrame:
    """Columns `keep` of each row, with n_words, base, detections and score (0 to 1)."""
    rows = documents.select(*[value.alias(name) for name, value in keep.items()], F.col(text_column).alias("__text"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(
        _scan, kinds + "n_words long, base array<struct<word:long,label:string>>, "
        "detections array<struct<start:long,stop:long,label:string,priority:int>>, score double"
    )
