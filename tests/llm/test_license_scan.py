import math
import re
import textwrap

import pytest

from graphloom.llm import common, queries
from graphloom.llm import license_scan as s

APACHE, MIT = (" ".join(s.TEMPLATES[k]) for k in ("Apache-2.0", "MIT"))
PROSE = "Words about nothing in particular go on and on. " * 20
FILES = [
    ("a/LICENSE", APACHE), ("a/b/x.py", PROSE), ("a/b/c/y.py", "Released under the MIT License.\n" + PROSE), ("a/b/c/z.py", PROSE),
    ("d/COPYING.txt", MIT + "\n" + PROSE), ("d/e/f.c", None), ("g/h.c", ""), ("top.c", PROSE), (None, PROSE), (None, MIT), ("a/b/x.py", PROSE),
    ("i/license notes.md", "I have a driving licence."), ("i/j.c", "Copyright is discussed here.\n" + PROSE),
]


@pytest.fixture
def files(spark):
    return spark.createDataFrame([(k, p, t, "x") for k, (p, t) in enumerate(FILES)], "n int, path string, text string, licence string")


def test_inheritance(files):
    rows = {r.n: r for r in s.scan(files, keep=("n",)).collect()}
    got = {k: (r.own_licence, r.licence, r.inherited_from) for k, r in rows.items()}
    none = (None, None, None)
    assert got[0] == ("Apache-2.0", "Apache-2.0", None) and got[2] == ("MIT", "MIT", None) and got[4] == ("MIT", "MIT", None)
    assert got[1] == got[3] == got[10] == (None, "Apache-2.0", "a") and got[5] == (None, "MIT", "d")
    assert got[6] == got[7] == got[8] == none and got[9] == ("MIT", "MIT", None) and got[11] == none
    assert len(rows) == len(FILES)


def plain_ratings(text):
    """For each paragraph that speaks of a licence, or its sentences where one fits better, (similarity, names, pieces), from counts and logarithms alone."""
    templates = s.all_templates()
    idf = {w: math.log((1 + len(templates)) / (1 + sum(w in t.bag for t in templates))) + 1 for t in templates for w in t.bag}

    def rated(part):
        bag = s.template_words(part)
        long = math.sqrt(sum((c * idf.get(w, 1)) ** 2 for w, c in bag.items()))
        fits = []
        for t in templates:
            if set(s.versions_of(t.bag)) <= set(s.versions_of(bag)) and set(t.bag) & set(s.MARKS) == set(bag) & set(s.MARKS) and long:
                fits.append((sum(bag[w] * c * idf[w] ** 2 for w, c in t.bag.items()) / long / math.sqrt(sum((c * idf[w]) ** 2 for w, c in t.bag.items())), t))
        top = max((c for c, _ in fits), default=0)
        near = [t for c, t in fits if c >= top - 0.01]
        return (top, {n for t in near for n in t.names}, {p for t in near for p in t.pieces}) if top >= 0.55 else None

    out = []
    for paragraph in re.split(s.PARAGRAPH, re.sub(s.SPDX, "", text)):
        if re.search(s.CUE, paragraph, re.I):
            whole = rated(paragraph)
            parts = [r for p in re.split(s.SENTENCE, paragraph) if re.search(s.CUE, p, re.I) and (r := rated(p))]
            out += parts if any(r[0] > (whole[0] if whole else -1) for r in parts) else [whole] if whole else []
    return out


def plain_licences(text):
    ratings = plain_ratings(text or "")
    ids = {n for e in re.findall(s.SPDX, text or "") for i in re.split(r"[()\s]+", e) for n in s.TEMPLATES if n not in (s.RESERVED, "BSD") and re.sub(r"(-only|-or-later|\+)$|[.]+$", "", i.lower()) == n.lower()}
    certain = ids | {n for _, names, _ in ratings if len(names) == 1 for n in names}
    pieces = {p for _, _, held in ratings for p in held}
    found = {n: 1.0 for n in ids}
    for similarity, names, _ in ratings:
        share = {n: len(pieces & set(s.BODIES[n])) / len(s.BODIES[n]) for n in names if n in s.BODIES}
        top = [n for n, x in share.items() if x >= 0.5 and x == max(share.values())]
        for n in names if len(names) == 1 else names & certain or (top if len(top) == 1 else []):
            found[n] = max(found.get(n, 0), similarity)
    order = sorted(found, key=lambda n: (n == s.RESERVED, -round(found[n], 9), n))
    return (order[0], ",".join(order), found[order[0]]) if order else (None, None, None)


def wrapped(text, mark=""):
    return "\n".join(mark + line for line in textwrap.wrap(text, 60))


BINARY = s.BODIES["BSD-2-Clause"]
KNOWN = [  # what a file says, and the licences in it
    ("BSD-2-Clause", "Copyright (c) 2020, A. Body\n\n" + "\n\n".join(map(wrapped, BINARY))),
    ("BSD-2-Clause", "Copyright (c) 1999 A. Body\n" + "\n".join(map(wrapped, BINARY[:3]))),
    ("BSD-3-Clause", "Copyright (c) 2020, A. Body\n\n" + "\n\n".join(map(wrapped, s.BODIES["BSD-3-Clause"]))),
    ("Apache-1.1", "The Apache Software License, Version 1.1\n\n" + "\n\n".join(map(wrapped, s.BODIES["Apache-1.1"]))),
    ("Apache-1.1", "\n\n".join(map(wrapped, s.BODIES["Apache-1.1"]))),
    ("MIT", "\n\n".join(map(wrapped, s.BODIES["MIT"]))), ("ISC", wrapped(s.BODIES["ISC"][0], " * ")),
    *[(n, wrapped(s._GNU.format(kind, version, what), "# ")) for n, kind, version, what in (("GPL-2.0", "", 2, "program"), ("GPL-3.0", "", 3, "program"), ("LGPL-2.1", "Lesser ", 2.1, "library"), ("LGPL-3.0", "Lesser ", 3, "library"), ("LGPL-2.0", "Library ", 2, "library"), ("AGPL-3.0", "Affero ", 3, "program"))],
    *[(n, wrapped(t)) for n in ("MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "BSL-1.0", "CC0-1.0") for t in s.TEXTS[n]], ("Unlicense", "\n\n".join(s.TEXTS["Unlicense"])),
    ("Apache-2.0,MIT", "// SPDX-License-Identifier: MIT OR Apache-2.0"), ("GPL-2.0,MIT", "/* SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR MIT) */"),
    *[(n, f"# SPDX-License-Identifier: {n}") for n in ("BSD-2-Clause", "LGPL-2.1", "CC0-1.0", "MPL-1.1", "ISC")], ("BSD", "Released under the BSD License."),
    ("", "SPDX-License-Identifier: FooBar-1.0"), ("", "Licensed under the Apache License."), ("", "Licensed under the GNU General Public License."), ("", "Licensed under CC BY 2.0."), ("", "Licensed under CC BY-ND 4.0."),
    ("", wrapped(s._GNU.format("", 1, "program"))), ("", "Licensed under the GNU Lesser General Public License, version 4."), ("", None), ("", ""),
]


def test_right_names_or_none(spark):
    files = spark.createDataFrame([(k, want, text) for k, (want, text) in enumerate(KNOWN)], "k int, want string, text string")
    rows = s.judged(files).collect()
    assert len(rows) == len(KNOWN)
    for r in rows:
        assert set((r.own_licences or "").split(",")) == set(r.want.split(",")), r


def test_judged_by_brute_force(spark):
    """Known texts, mixtures of them, files of the other tests, and one that is very long."""
    texts = [t for _, t in KNOWN] + [t for _, t in FILES] + [f"{a}\n\n{b}" for (_, a), (_, b) in zip(KNOWN, KNOWN[3:], strict=False) if a and b]
    texts += ["\n\n".join([PROSE * 300, BINARY[0], PROSE * 300]), GPL2, MIT_FILE + "\n" + GPL2, GPL2.replace("2 of", "2.1 of"), "license " * 30_000]
    rows = s.judged(spark.createDataFrame(list(enumerate(texts)), "k int, text string")).collect()
    for r in rows:
        name, names, similarity = plain_licences(texts[r.k])
        assert (r.own_licence, r.own_licences) == (name, names), r.k
        assert similarity is None and r.similarity is None or abs(r.similarity - similarity) < 1e-8


def test_query_by_brute_force(spark):
    """The registered query over a whole table: own licences text by text, inheritance by a walk up the path."""
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").collect()
    path = {d.doc_id: f"{d.source}/{d.lang}/{d.doc_id // 100}/{d.doc_id}" for d in docs}
    got = {r.doc_id: r for r in queries.op10_licences(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    declared = {}
    for d in docs:
        name, names, similarity = plain_licences(d.text)
        r = got[d.doc_id]
        assert (r.own_licence, r.own_licences) == (name, names) and (name is None or abs(r.similarity - similarity) < 1e-8)
        if name and r.licence_share >= 0.02:
            declared.setdefault(path[d.doc_id].rsplit("/", 1)[0], []).append((-r.similarity, name))
    for k, r in got.items():
        if r.own_licence is None:
            home = path[k].rsplit("/", 1)[0].split("/")
            near = next((x for x in ("/".join(home[:n]) for n in range(len(home), -1, -1)) if x in declared), None)
            assert (r.licence, r.inherited_from) == ((min(declared[near])[1], near) if near is not None else (None, None))
        else:
            assert r.licence == r.own_licence and r.inherited_from is None


def test_empty_and_native(files):
    assert s.scan(files.where("false")).count() == 0
    plan = s.scan(files)._jdf.queryExecution().toString() + s.judged(files)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rights_reserved_alone(spark):
    """At any size: among files that lack the template's other words too."""
    texts = ["All rights reserved.", "Copyright 2020 Foo. All rights reserved.", "Unauthorized copying of this file is strictly prohibited. All rights reserved.", "Copyright is discussed here."]
    for n in (0, 5000):
        files = spark.createDataFrame([(k, f"d{k}/x", t) for k, t in enumerate(texts)] + [(9, f"e{k}/x", "The licence of our driver.") for k in range(n)], "n int, path string, text string")
        got = {r.n: r.own_licence for r in s.scan(files, keep=("n",)).collect()}
        assert [got[k] for k in range(4)] == ["Proprietary"] * 3 + [None]


GPL2 = """/*
 * Frobnicate, a tool. Copyright (C) 2001 A. Body
 *
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 */
int main() {}"""
MIT_FILE = """MIT License

Copyright (c) 2020 A. Body. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


def test_passages_by_themselves(spark):
    chatter = "\n".join(f"Line {k} mentions the copyright of others, and more besides." for k in range(10))
    texts = {
        "MIT": "Released under the MIT License.\n" + chatter,
        "GPL-2.0": GPL2, "MIT ": MIT_FILE, "Apache-2.0": "# SPDX-License-Identifier: Apache-2.0\nimport os", "GPL-3.0": "// SPDX-License-Identifier: GPL-3.0-or-later",
        "MIT,CC-BY-4.0": "Released under the MIT License.\nSome words.\nLicensed under CC BY 4.0.", "": chatter, " ": "SPDX-License-Identifier: FooBar-1.0",
    }
    files = spark.createDataFrame([(k, f"{i}/x", t) for i, (k, t) in enumerate(texts.items())], "want string, path string, text string")
    rows = s.scan(files, keep=("want",)).collect()
    for r in rows:
        want = r.want.strip() or None
        assert set((r.own_licences or "").split(",")) - {s.RESERVED} == set((want or "").split(",")), r
        assert r.own_licence == (want and r.own_licences.split(",")[0]) and r.own_licence != s.RESERVED
    assert len(rows) == len(texts)
    plan = s.judged(files)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
