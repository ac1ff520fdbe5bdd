"""Labels of common spellings, and texts that are about other things."""

from pathlib import Path

import pytest

from fablens.llm.license_rules import MARKS, NAMES, NOTICES, PASSAGES
from fablens.llm.licenses import scan


@pytest.mark.parametrize("text, labels", [
    ("licensed under GPLv3", {"gpl-3"}),
    ("LGPLv2.1 or later", {"lgpl-2.1-or-later"}),
    ("released under the AGPLv3", {"agpl-3"}),
    ("License: MIT", {"mit"}),
    ('license = "Apache-2.0"', {"apache-2.0"}),
    ('"license": "BSD-3-Clause"', {"bsd-3-clause"}),
    ("SPDX-License-Identifier: GPL-3.0-or-later", {"gpl-3-or-later"}),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0)", {"mit", "apache-2.0"}),
    ("SPDX-License-Identifier: LGPL-2.1-only AND CC-BY-4.0", {"lgpl-2.1", "cc-by-4.0"}),
    ("license: MPL-2.0", {"mpl-2.0"}),
    ("GNU General Public License, version 2", {"gpl-2"}),
    ("Mozilla Public License 2.0", {"mpl-2.0"}),
    ("the driver needs a license and a helmet", set()),
    ("apache helicopters and bsd daemons", set()),
    ("we went to MIT to study", set()),
    ("gplv and version 3 of the plan", set()),
])
def test_spellings(text, labels):
    found = {label for _, _, label, _ in scan(text)["detections"]}
    assert {x for x in found if x not in ("copyright", "proprietary")} == labels


def test_labelled_snippets():
    """Labels of own snippets, one or more each or none, against those found: what is found and what should be."""
    lines = (Path(__file__).parent / "license_snippets.txt").read_text(encoding="utf-8").splitlines()
    cases = [line.split(" | ", 1) for line in lines]
    assert len(cases) >= 200
    right = wanted = found = 0
    wrong = []
    for labels, text in cases:
        want = set() if labels == "-" else set(labels.split(","))
        got = {label for _, _, label, _ in scan(text)["detections"]}
        right, wanted, found = right + len(want & got), wanted + len(want), found + len(got)
        if want != got:
            wrong.append((text, want, got))
    assert right / wanted > 0.95 and right / found > 0.95, wrong


@pytest.mark.parametrize("text, words, labels", [
    ("GPL-2.0+", 3, {"gpl-2-or-later"}), ("GPLv2+, MPL-1.1", 4, {"gpl-2-or-later", "mpl-1.1"}), ("GPL 2.0 + x", 4, {"gpl-2"}),
    ("GPL-2.0++", 3, {"gpl-2"}), ("GPL-2.0+b", 4, {"gpl-2"}), ("1+2 + 3+ +", 3, set()), ("LGPL-2.1+é", 4, {"lgpl-2.1"}),
])
def test_plus_behind_a_version(text, words, labels):
    got = scan(text)
    assert got["n_words"] == words and {label for _, _, label, _ in got["detections"]} == labels


def test_keywords_of_hand_written_rules():
    """A rule is only tried where its keyword occurs, so the keyword must stand in the pattern itself."""
    for table in (NOTICES, PASSAGES, MARKS, NAMES):
        for label, keyword, pattern in table:
            assert keyword in pattern or keyword in pattern.replace("licen[sc]e", "license"), (label, keyword)
