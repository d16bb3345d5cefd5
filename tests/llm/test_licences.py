import numpy as np
import pytest
from conftest_llm import frame, rows

from sieveline.llm import licences


@pytest.mark.parametrize(
    ("text", "canonical", "cls"),
    [
        ("mit", "MIT", "permissive"),
        ("MIT OR GPL-3.0-only", "MIT OR GPL-3.0-only", "permissive"),
        ("MIT AND GPL-3.0-only", "MIT AND GPL-3.0-only", "copyleft"),
        ("MIT OR Apache-2.0 AND GPL-2.0", "MIT OR Apache-2.0 AND GPL-2.0-only", "permissive"),
        ("(MIT OR Apache-2.0) AND AGPL-3.0-only", "(MIT OR Apache-2.0) AND AGPL-3.0-only", "network-copyleft"),
        ("GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only WITH Classpath-exception-2.0", "weak-copyleft"),
        ("GPL-2.0-only WITH no-such-exception", "GPL-2.0-only WITH no-such-exception", "unknown"),
        ("gpl-2.0+", "GPL-2.0-or-later", "copyleft"),
        ("((ISC))", "ISC", "permissive"),
        ("MIT and (LGPL-2.1-only or MPL-2.0)", "MIT AND (LGPL-2.1-only OR MPL-2.0)", "weak-copyleft"),
        ("Made-Up-1.0 OR MIT", "Made-Up-1.0 OR MIT", "permissive"),
    ],
)
def test_expressions(text, canonical, cls):
    got, level, _ = licences.evaluate(text)
    assert (got, licences.CLASSES[level]) == (canonical, cls)


@pytest.mark.parametrize("text", ["", "MIT OR", "AND MIT", "(MIT", "MIT)", "MIT Apache-2.0", "MIT OR OR ISC", "MIT &&", "(MIT OR ISC) WITH Classpath-exception-2.0", "()", "WITH"])
def test_malformed(text):
    with pytest.raises(licences.Malformed):
        licences.evaluate(text)


def test_postfix_against_recursive_descent():
    import random

    rng = random.Random(1)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            i = rng.choice(["MIT", "ISC", "GPL-3.0-only", "AGPL-3.0-only", "CC0-1.0"])
            return i, licences.licence(i)[1]
        op = rng.choice(["AND", "OR"])
        (a, x), (b, y) = make(depth - 1), make(depth - 1)
        return f"({a}) {op} ({b})", (max if op == "AND" else min)(x, y)

    for _ in range(300):
        text, level = make(4)
        canonical, got, _ = licences.evaluate(text)
        assert got == level and licences.evaluate(canonical)[:2] == (canonical, level)


TEXTS = {
    1: ("// SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception\nint main();", "Apache-2.0", "Apache-2.0 WITH LLVM-exception", "permissive", 1),
    2: ("Licensed under the Apache License, Version 2.0 (the\n License).", "Apache-2.0", "Apache-2.0", "permissive", 1),
    3: ("GNU General Public License version 3 or any later version; the MIT License too. The MIT license.", "GPL-3.0-or-later;MIT", "GPL-3.0-or-later AND MIT", "copyleft", 3),
    4: ("/* SPDX-License-Identifier: MIT OR GPL-2.0 */ and the ISC License", "GPL-2.0-only;ISC;MIT", "ISC AND (MIT OR GPL-2.0-only)", "permissive", 2),
    5: ("SPDX-License-Identifier: MIT OR", "", None, "unknown", 1),
    6: ("an honest summit license commit", "", None, "none", 0),
    7: ("Permission to submit licenses", "", None, "none", 0),
    8: ("All rights reserved.", "LicenseRef-All-Rights-Reserved", "LicenseRef-All-Rights-Reserved", "proprietary", 1),
}


TEXTS |= {
    9: ("SPDX-License-Identifier: MIT in this file", "MIT", "MIT", "permissive", 1),
    10: ("licensed under gpl-3.0", "GPL-3.0-only", "GPL-3.0-only", "copyleft", 1),
    11: ("Apache-2.0, or else LGPL version 2.1", "Apache-2.0;LGPL-2.1-only", "Apache-2.0 AND LGPL-2.1-only", "weak-copyleft", 2),
    12: ("this is BSD licensed", "LicenseRef-BSD", "LicenseRef-BSD", "permissive", 1),
    13: ("Python 2.0 and PHP 3.0 on Apache; see the Ruby license", "Ruby", "Ruby", "permissive", 1),
    14: ("# SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR MIT, see MPL-2.0\n", "GPL-2.0-only;MIT;MPL-2.0", "MPL-2.0 AND (GPL-2.0-only WITH Linux-syscall-note OR MIT)", "weak-copyleft", 2),
    15: ("SPDX-License-Identifier: (MIT", "", None, "unknown", 1),
    16: ("SPDX-License-Identifier:\nMIT license", "MIT", "MIT", "unknown", 2),
    17: ("GPL-2.0-or-later and GFDL-1.3-only", "GFDL-1.3-only;GPL-2.0-or-later", "GPL-2.0-or-later AND GFDL-1.3-only", "copyleft", 2),
    18: ("word " * 200_000 + "SPDX-License-Identifier: ISC\n" + "word " * 200_000 + "MIT License", "ISC;MIT", "MIT AND ISC", "permissive", 2),
}


def test_scan(spark, odd, empty):
    got = {r.doc_id: tuple(r)[1:] for r in licences.scanned(frame(spark, [(i, t[0], "en", "web") for i, t in TEXTS.items()])).collect()}
    assert got == {i: t[1:] for i, t in TEXTS.items()}
    assert all(r["class"] == "none" and r.hits == 0 for r in licences.scanned(odd).collect())
    assert licences.scanned(odd).count() == odd.count() and rows(licences.scanned(empty)) == []


def test_scan_against_naive_search():
    """Random texts of words of phrases: the leftmost longest hits of a search of every phrase at every word."""
    import random

    rng = random.Random(8)
    all_ = {p: licences.BSD_TEXTS.get(p, i) for i, ps in licences.PHRASES.items() for p in ps}
    some = rng.sample(sorted(all_), 400)
    vocabulary = sorted({w for p in some for w in p.split()})
    for _ in range(60):
        words = [w for _ in range(30) for w in (rng.choice(some).split() if rng.random() < 0.6 else [rng.choice(vocabulary)])]
        raw = np.frombuffer((", ".join(words) + "\n").encode(), np.uint8)
        got = licences.phrases(np.array([0, len(raw)]), raw).get(0, [])
        want, at = [], 0
        while at < len(words):
            fit = [n for n in range(1, 40) if at + n <= len(words) and " ".join(words[at : at + n]) in all_]
            if fit:
                want.append(all_[" ".join(words[at : at + max(fit)])])
            at += max(fit, default=1)
        assert got == want


@pytest.mark.parametrize(("text", "want"), [("MIT in this", "MIT"), ("MIT OR ISC) x", "MIT OR ISC"), ("(MIT", "(MIT"), ("MIT AND", "MIT AND"), (", MIT", ""), ("MIT, ISC", "MIT"), ("mit*", "mit")])
def test_leading(text, want):
    assert licences.leading(text)[0] == want


def test_phrases_against_brute_force():
    """Every phrase is found in a text that holds it alone; and at its place in a long one."""
    phrases = [(i, p) for i, ps in licences.PHRASES.items() for p in ps]
    raw = [f"{p}\n".encode() for _, p in phrases]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    names, *_ = licences.scan(off, np.frombuffer(b"".join(raw), np.uint8))
    assert names == [i for i, _ in phrases]


FSF = "it under the terms of the GNU{} General Public License as published by the\n * Free Software Foundation; either version {} of the License, or (at your option)\n * any later version."
BSD = "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:"
NAMES = "Neither the name of X nor the names of its contributors may be used to endorse or promote products\n derived from this software without specific prior written permission."
ADS = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: made by X."


@pytest.mark.parametrize(
    ("text", "name", "cls"),
    [
        (FSF.format("", 3), "GPL-3.0-or-later", "copyleft"),
        (FSF.format("", 2), "GPL-2.0-or-later", "copyleft"),
        (FSF.format("", 1), "GPL-1.0-or-later", "copyleft"),
        (FSF.format(" Lesser", "2.1"), "LGPL-2.1-or-later", "weak-copyleft"),
        (FSF.format(" Lesser", 3), "LGPL-3.0-or-later", "weak-copyleft"),
        (FSF.format(" Library", 2), "LGPL-2.0-or-later", "weak-copyleft"),
        (FSF.format(" Affero", 3), "AGPL-3.0-or-later", "network-copyleft"),
        ("under version 2 of the GNU General Public License as published by the Free Software Foundation.", "GPL-2.0-only", "copyleft"),
        ("the GNU General Public License as published by the Free Software Foundation, version 2.", "GPL-2.0-only", "copyleft"),
        ("GNU Lesser General Public License v2.1", "LGPL-2.1-only", "weak-copyleft"),
        ("GNU Lesser General Public License v3", "LGPL-3.0-only", "weak-copyleft"),
        ("GNU General Public License v3 or later", "GPL-3.0-or-later", "copyleft"),
        ("GNU GPL version 2 or later", "GPL-2.0-or-later", "copyleft"),
        ("subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy", "MPL-2.0", "weak-copyleft"),
        (BSD, "BSD-2-Clause", "permissive"),
        (f"{BSD} {NAMES}", "BSD-3-Clause", "permissive"),
        (f"{BSD} {ADS} {NAMES}", "BSD-4-Clause", "permissive"),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above", "ISC", "permissive"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED", "0BSD", "public-domain"),
        ("terms of the Eclipse Public License v1.0 which", "EPL-1.0", "weak-copyleft"),
        ("the Common Development and Distribution License (the License)", "CDDL-1.0", "weak-copyleft"),
    ],
)
def test_notices(text, name, cls):
    raw = np.frombuffer(f"/* {text}\n".lower().encode(), np.uint8)
    names, _, classes, hits = licences.scan(np.array([0, len(raw)]), raw)
    assert (names, classes, list(hits)) == ([name], [cls], [1])


def test_every_licence_has_phrases():
    assert {i.lower() for i in licences.PHRASES} == set(licences.CLASS_OF)
    said = [p for ps in licences.PHRASES.values() for p in ps]
    assert len(said) == len(set(said))
