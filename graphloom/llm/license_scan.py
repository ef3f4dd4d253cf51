"""Licence scan: sparse TF-IDF cosine of licence-bearing passages to templates, then inheritance from the nearest directory.

Every paragraph of a file that speaks of a licence, and every sentence or line in it that does, is compared by itself with each
template in the space of the templates' words; other words only lengthen its vector, and word weights come from the templates alone,
so the size of the corpus and other passages change nothing. The templates' vectors are an inverted index: a passage looks each of its
words up once and sums what it finds by template. A paragraph counts as a whole (a wrapped header, a licence's text) unless a
sentence of it fits better; then its sentences count.

Sibling licences differ in little, so a template is only compared if its version numbers stand in the passage and both have the same of
the words that part siblings (MARKS). Licences within `margin` of a passage's best stay candidates together, as they do
where they share a text. Of such candidates those count that another passage of the file names alone; if there are none, the one of whose
texts the file holds the largest share, from a half on; if that is not a single one, the passage names none. SPDX expressions are taken apart and name
each known licence in them; unknown identifiers name none.

A file's licence is the most similar one found, a reservation of rights only if there is no other; own_licences lists all of them. A
file without a licence of its own takes the one of the licence file in the nearest directory above it, by joins of its path's prefixes
with the directories that have one; a directory with many files is dealt to several tasks. All of it is DataFrame operations.

Defined results: null and empty texts have no licence of their own; a null path inherits nothing; repeated rows are judged
alike; a paragraph ends at a blank line or one of comment marks only; equal similarities list the first licence by name first; if a directory has several licence files, the most similar one counts,
then the first licence by name; an empty table gives no rows. Extra columns pass, unless they are called like the ones made.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.joins import spread_join

from .common import stored

#: Notices by which licences are declared, under their SPDX names. BSD stands for a BSD licence of unstated kind.
RESERVED = "Proprietary"
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License. Apache License, Version 2.0."),
    "Apache-1.1": ("Licensed under the Apache Software License, Version 1.1.",),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1.",),
    "LGPL-2.0": ("Licensed under the GNU Library General Public License, version 2.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "BSD": ("Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "Simplified BSD License."),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "New BSD License.", "Modified BSD License."),
    "ISC": ("Released under the ISC License.",),
    "MPL-2.0": ("This source code form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "MPL-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1.",),
    "EPL-1.0": ("Licensed under the Eclipse Public License, version 1.0.",),
    "EPL-2.0": ("Licensed under the Eclipse Public License, version 2.0.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "Unlicense": ("Released under the Unlicense.",),
    "CC0-1.0": ("Licensed under CC0 1.0.", "Licensed under CC0 1.0 Universal Public Domain Dedication."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Licensed under the Creative Commons Attribution 4.0 International License."),
    "CC-BY-3.0": ("Licensed under CC BY 3.0.", "Licensed under the Creative Commons Attribution 3.0 Unported License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-SA-3.0": ("Licensed under CC BY-SA 3.0.", "Licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    RESERVED: ("All rights reserved.", "Copyright. All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."),
}
_GNU = "This {2} is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_SHORT_GNU = "This {2} is free software; you can redistribute it and/or modify it under the terms of the GNU {0}General Public License version {1} as published by the Free Software Foundation."
_EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License {0} which accompanies this distribution, and is available at {1}"
_BINARY = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
_BROADLY = " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: The paragraphs of short licences in their order; a file may hold any run of them as one paragraph.
BODIES = {
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "BSD-2-Clause": (*_BINARY, _AS_IS + _BROADLY),
    "BSD-3-Clause": (*_BINARY, _ENDORSE, _AS_IS + _BROADLY),
    "Apache-1.1": (
        *_BINARY,
        'The end-user documentation included with the redistribution, if any, must include the following acknowledgment: "This product includes software developed by the Apache Software Foundation (http://www.apache.org/)." Alternately, this acknowledgment may appear in the software itself, if and wherever such third-party acknowledgments normally appear.',
        'The names "Apache" and "Apache Software Foundation" must not be used to endorse or promote products derived from this software without prior written permission.',
    ),
}
#: Headings and headers of licences.
TEXTS = {
    "Apache-2.0": (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "Apache-1.1": ("The Apache Software License, Version 1.1",),
    "MIT": ("The MIT License",),
    "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License", _AS_IS),
    "BSD-3-Clause": ("BSD 3-Clause License", _AS_IS),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _GNU.format("", 3, "program"), _SHORT_GNU.format("", 3, "program")),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _GNU.format("", 2, "program"), _SHORT_GNU.format("", 2, "program")),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", *(x.format("Lesser ", 3, y) for x in (_GNU, _SHORT_GNU) for y in ("program", "library"))),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", *(x.format("Lesser ", 2.1, y) for x in (_GNU, _SHORT_GNU) for y in ("program", "library"))),
    "LGPL-2.0": ("GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991", *(x.format("Library ", 2, "library") for x in (_GNU, _SHORT_GNU))),
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", _GNU.format("Affero ", 3, "program"), _SHORT_GNU.format("Affero ", 3, "program")),
    "MPL-2.0": (
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "MPL-1.1": (
        "Mozilla Public License Version 1.1",
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/',
    ),
    "EPL-1.0": ("Eclipse Public License - v 1.0", _EPL.format("v1.0", "http://www.eclipse.org/legal/epl-v10.html")),
    "EPL-2.0": ("Eclipse Public License - v 2.0", _EPL.format("2.0", "https://www.eclipse.org/legal/epl-2.0/")),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "For more information, please refer to http://unlicense.org"),
    "CC0-1.0": ("Creative Commons Legal Code CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal Public Domain Dedication", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International Public License",),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International Public License",),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International Public License",),
}
#: Words by which sibling licences differ.
MARKS = (
    "lesser", "library", "affero", "2-clause", "3-clause", "4-clause", "simplified", "new", "modified", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd",
    "attribution-sharealike", "attribution-noncommercial", "attribution-noderivatives", "attribution-noderivs",
    "attribution-noncommercial-sharealike", "attribution-noncommercial-noderivatives", "attribution-noncommercial-noderivs",
)
CUE = "licen[cs]e|copyright|spdx|all rights reserved|redistribution|unencumbered|creative commons"
CUE_STEMS = ("licen", "copyright", "spdx", "all rights reserved", "redistribution", "unencumbered", "creative commons")
PARAGRAPH = r"\n[ \t\r]*(?:[*#/;-]+[ \t\r]*)?(?=\n)"
SENTENCE = r"\n|(?<=[.;])\s+(?=[A-Z])"
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)"
VERSION = r"^v?([0-9](?:\.[0-9])?)$"


@dataclass(frozen=True)
class LicenceRules:
    least_similarity: float = 0.55
    margin: float = 0.01  #: licences as near as this to the best one of a passage stay candidates with it
    file_share: float = 0.5  #: share of a file's words in licence passages from which it is a licence file


@dataclass(frozen=True)
class Template:
    """A text, the licences that hold it, its words, and which pieces of the licences' bodies it is."""

    text: str
    names: tuple[str, ...]
    bag: Counter
    pieces: tuple[str, ...] = ()


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.+-]+"), lambda w: F.length(F.btrim(w, F.lit(".+-"))) > 0)


def stripped(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.btrim(w, F.lit(".+-")))


def template_words(text: str) -> Counter:
    return Counter(w.strip(".+-") for w in re.split(r"[^a-z0-9.+-]+", text.lower()) if w.strip(".+-"))


def versions_of(bag: Counter) -> tuple[str, ...]:
    found = (re.match(VERSION, w) for w in bag)
    return tuple(sorted({m[1].removesuffix(".0") for m in found if m}))


@cache
def all_templates() -> tuple[Template, ...]:
    """Every notice, heading and run of body paragraphs once, with all licences that it belongs to."""
    named: dict[str, set[str]] = {}
    pieces: dict[str, tuple[str, ...]] = {}
    for group in (TEMPLATES, TEXTS):
        for name, texts in group.items():
            for text in texts:
                named.setdefault(text, set()).add(name)
    for name, body in BODIES.items():
        for a in range(len(body)):
            for b in range(a + 1, len(body) + 1):
                run = " ".join(body[a:b])
                named.setdefault(run, set()).add(name)
                pieces[run] = body[a:b]
    return tuple(Template(text, tuple(sorted(names)), template_words(text), pieces.get(text, ())) for text, names in sorted(named.items()))


def passages(text: Column) -> Column:
    """The lines and sentences that speak of a licence, joined; null if there are none."""
    low = F.lower(text)
    speaks = F.lit(False)
    for stem in CUE_STEMS:
        speaks = speaks | low.contains(stem)
    parts = F.filter(F.split(text, SENTENCE), lambda p: p.rlike("(?i)" + CUE))
    return F.when(speaks, F.array_join(parts, "\n"))


def _norm(tokens: Column, weight: Column) -> Column:
    """The length of the tokens' vector; words without a weight have one of 1."""
    return F.aggregate(
        F.array_sort(tokens),
        F.struct(F.lit(None).cast("string").alias("word"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total")),
        lambda acc, w: F.when(acc["word"] == w, F.struct(w.alias("word"), (acc["run"] + 1.0).alias("run"), acc["total"].alias("total"))).otherwise(
            F.struct(w.alias("word"), F.lit(1.0).alias("run"), (acc["total"] + F.pow(acc["run"] * F.coalesce(F.element_at(weight, acc["word"]), F.lit(1.0)), F.lit(2.0))).alias("total"))
        ),
        lambda acc: F.sqrt(acc["total"] + F.pow(acc["run"] * F.coalesce(F.element_at(weight, acc["word"]), F.lit(1.0)), F.lit(2.0))),
    )


def _strings(values: tuple[str, ...] | list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _literal(value: object, kind: str) -> Column:
    """A constant that the optimizer reads once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


class _Index:
    """The templates as literal columns: word -> [(template, share of the cosine)], and what a template asks of a passage."""

    def __init__(self, templates: tuple[Template, ...]):
        held = Counter(w for t in templates for w in t.bag)
        idf = {w: math.log((1 + len(templates)) / (1 + k)) + 1 for w, k in sorted(held.items())}
        postings: dict[str, list[dict]] = {w: [] for w in idf}
        for k, t in enumerate(templates):
            length = math.sqrt(sum((c * idf[w]) ** 2 for w, c in t.bag.items()))
            for w, c in t.bag.items():
                postings[w].append({"t": k, "v": c * idf[w] * idf[w] / length})
        asks = [{"versions": versions_of(t.bag), "marks": sorted(set(t.bag) & set(MARKS)), "names": t.names, "pieces": t.pieces} for t in templates]
        self.weight = _literal(idf, "map<string,double>")
        self.postings = _literal(postings, "map<string,array<struct<t:int,v:double>>>")
        self.asks = _literal(asks, "array<struct<versions:array<string>,marks:array<string>,names:array<string>,pieces:array<string>>>")
        self.last = F.struct(F.lit(len(templates)).alias("t"), F.lit(0.0).alias("v"))

    def cosines(self, tokens: Column) -> Column:
        """[(t, s)] of the templates with a word in the tokens, before division by the tokens' own length."""
        found = F.flatten(F.filter(F.transform(tokens, lambda w: F.element_at(self.postings, w)), lambda p: p.isNotNull()))
        nothing = F.array().cast("array<struct<t:int,s:double>>")
        return F.aggregate(
            F.concat(F.array_sort(found), F.array(self.last)),
            F.struct(F.lit(-1).alias("t"), F.lit(0.0).alias("run"), nothing.alias("out")),
            lambda acc, p: F.when(acc["t"] == p["t"], F.struct(acc["t"].alias("t"), (acc["run"] + p["v"]).alias("run"), acc["out"].alias("out"))).otherwise(
                F.struct(p["t"].alias("t"), p["v"].alias("run"), F.when(acc["t"] >= 0, F.array_append(acc["out"], F.struct(acc["t"].alias("t"), acc["run"].alias("s")))).otherwise(acc["out"]).alias("out"))
            ),
            lambda acc: acc["out"],
        )

    def rated(self, bags: Column, rules: LicenceRules) -> Column:
        """For each bag of words its best similarity, and the names and pieces of all that are as near as the margin; null if none fits."""
        sized = F.transform(
            bags,
            lambda t: F.struct(
                self.cosines(t).alias("cosines"), _norm(t, self.weight).alias("norm"), F.array_intersect(t, _strings(MARKS)).alias("marks"),
                F.transform(F.filter(t, lambda w: w.rlike(VERSION)), lambda w: F.regexp_replace(F.regexp_extract(w, VERSION, 1), r"\.0$", "")).alias("versions"),
            ),
        )

        def fits(x: Column, c: Column) -> Column:
            ask = self.asks[c["t"]]
            return (F.size(F.array_except(ask["versions"], x["versions"])) == 0) & (F.size(F.array_except(x["marks"], ask["marks"])) == 0) & (F.size(F.array_except(ask["marks"], x["marks"])) == 0)

        scored = F.transform(sized, lambda x: F.transform(F.filter(x["cosines"], lambda c: fits(x, c)), lambda c: F.struct(F.round(c["s"] / x["norm"], 9).alias("s"), c["t"].alias("t"))))
        topped = F.transform(scored, lambda cs: F.struct(F.array_max(cs)["s"].alias("similarity"), cs.alias("cs")))
        near = F.transform(topped, lambda x: F.struct(x["similarity"].alias("similarity"), F.transform(F.filter(x["cs"], lambda c: c["s"] >= x["similarity"] - rules.margin), lambda c: self.asks[c["t"]]).alias("near")))
        return F.transform(
            near,
            lambda x: F.when(
                x["similarity"] >= rules.least_similarity,
                F.struct(x["similarity"].alias("similarity"), F.array_distinct(F.flatten(F.transform(x["near"], lambda n: n["names"]))).alias("names"), F.flatten(F.transform(x["near"], lambda n: n["pieces"])).alias("pieces")),
            ),
        )


def _chosen(passage: Column, certain: Column, pieces: Column) -> Column:
    """The licences that a passage's candidates come down to, given what else the file holds."""
    bodies = F.map_from_arrays(_strings(list(BODIES)), F.array(*[_strings(b) for b in BODIES.values()]))
    share = lambda n: F.size(F.array_intersect(F.element_at(bodies, n), pieces)) / F.size(F.element_at(bodies, n))
    held = F.filter(F.transform(passage["names"], lambda n: F.struct(F.coalesce(share(n), F.lit(0.0)).alias("share"), n.alias("name"))), lambda x: x["share"] >= 0.5)
    top = F.transform(F.array(held), lambda h: F.transform(F.filter(h, lambda x: x["share"] == F.array_max(h)["share"]), lambda x: x["name"]))[0]
    known = F.array_intersect(passage["names"], certain)
    return F.when(F.size(passage["names"]) == 1, passage["names"]).when(F.size(known) > 0, known).when(F.size(top) == 1, top).otherwise(F.array().cast("array<string>"))


def declared_ids(text: Column) -> Column:
    """The known licences in SPDX expressions, under the names used here."""
    known = sorted(set(TEMPLATES) - {RESERVED, "BSD"})
    names = F.map_from_arrays(_strings([n.lower() for n in known]), _strings(known))
    ids = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SPDX), 1), lambda e: F.split(F.lower(e), r"[()\s]+")))
    return F.array_distinct(F.filter(F.transform(ids, lambda i: F.element_at(names, F.regexp_replace(i, r"(-only|-or-later|\+)$|[.]+$", ""))), lambda n: n.isNotNull()))


def judged(files: DataFrame, rules: LicenceRules = LicenceRules(), text_col: str = "text", templates: tuple[Template, ...] | None = None) -> DataFrame:
    """files with own_licence, own_licences, similarity and licence_share, every passage compared by itself."""
    index = _Index(templates or all_templates())
    speaks = lambda p: p.rlike("(?i)" + CUE)
    tokens = lambda p: stripped(words(p))
    found = files.withColumn("_tokens", stripped(words(passages(F.col(text_col)))))
    some = F.size("_tokens") > 0
    plain = F.regexp_replace(text_col, SPDX, "")
    bags = F.transform(F.filter(F.split(plain, PARAGRAPH), speaks), lambda p: F.struct(tokens(p).alias("whole"), F.transform(F.filter(F.split(p, SENTENCE), speaks), tokens).alias("parts")))
    scored = found.withColumn("_ids", F.when(some, declared_ids(F.col(text_col)))).withColumn("_bags", F.when(some, bags))
    scored = scored.withColumn("_scores", F.transform("_bags", lambda b: F.struct(index.rated(F.array(b["whole"]), rules)[0].alias("whole"), index.rated(b["parts"], rules).alias("parts"))))
    better = lambda x: F.exists(x["parts"], lambda p: p["similarity"] > F.coalesce(x["whole"]["similarity"], F.lit(-1.0)))
    winners = F.filter(F.flatten(F.transform("_scores", lambda x: F.when(better(x), x["parts"]).otherwise(F.array(x["whole"])))), lambda x: x.isNotNull())
    scored = scored.withColumn("_winners", winners).drop("_scores", "_bags")
    certain = F.concat(F.flatten(F.transform(F.filter("_winners", lambda x: F.size(x["names"]) == 1), lambda x: x["names"])), F.col("_ids"))
    scored = scored.withColumn("_certain", certain).withColumn("_pieces", F.flatten(F.transform("_winners", lambda x: x["pieces"])))
    rank = lambda s, n: F.struct((n == RESERVED).alias("reserved"), (-s).alias("s"), n.alias("name"))
    by_text = F.flatten(F.transform("_winners", lambda x: F.transform(_chosen(x, F.col("_certain"), F.col("_pieces")), lambda n: rank(x["similarity"], n))))
    scored = scored.withColumn("_ranks", F.array_sort(F.concat(by_text, F.transform("_ids", lambda n: rank(F.lit(1.0), n)))))
    first = F.element_at(F.col("_ranks"), 1)
    some_fit = F.size("_ranks") > 0
    total = F.size(F.split(F.btrim(F.col(text_col)), r"\s+"))
    own = [c for c in files.columns if c not in ("own_licence", "own_licences", "similarity", "licence_share")]
    return scored.select(
        *own, F.when(some_fit, first["name"]).alias("own_licence"), F.when(some_fit, F.array_join(F.array_distinct(F.transform("_ranks", lambda x: x["name"])), ",")).alias("own_licences"),
        F.when(some_fit, -first["s"]).alias("similarity"), F.when(some, F.round(F.size("_tokens") / total, 6)).alias("licence_share"),
    )


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first: a/b/c gives a/b, a and the empty root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def scan(files: DataFrame, rules: LicenceRules = LicenceRules(), path_col: str = "path", text_col: str = "text", templates: tuple[Template, ...] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per file: keep columns, path, own_licence, own_licences, similarity, licence_share, licence, inherited_from."""
    found = stored(judged(files.select(*keep, path_col, text_col), rules, text_col, templates).select(*keep, path_col, "own_licence", "own_licences", "similarity", "licence_share"), "licences")
    by_name = F.regexp_extract(path_col, r"([^/]*)$", 1).rlike(r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$")
    declared = found.where(F.col("own_licence").isNotNull() & F.col(path_col).isNotNull() & ((F.col("licence_share") >= rules.file_share) | by_name))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("own_licence").alias("licence")))
    directories = declared.groupBy(F.element_at(ancestors(F.col(path_col)), 1).alias("_dir")).agg(best.alias("_best")).select("_dir", F.col("_best.licence").alias("_licence"))
    places = found.select(F.element_at(ancestors(F.col(path_col)), 1).alias("_home")).where("_home IS NOT NULL").distinct()
    steps = places.select("_home", F.posexplode(F.array_prepend(ancestors(F.col("_home")), F.col("_home"))).alias("_step", "_dir"))
    nearest = spread_join(steps, stored(directories, "declared"), "_dir", "_home").groupBy("_home").agg(F.min(F.struct("_step", "_dir", "_licence")).alias("_near"))
    # files without a path inherit nothing, and get keys of their own so that they don't meet under a null one
    homes = found.withColumn("_home", F.coalesce(F.element_at(ancestors(F.col(path_col)), 1), F.concat(F.lit("\n"), F.xxhash64("*").cast("string"))))
    joined = spread_join(homes, stored(nearest, "nearest"), "_home", path_col, "left")
    inherits = F.col("own_licence").isNull()
    return joined.select(*keep, path_col, "own_licence", "own_licences", "similarity", "licence_share", F.coalesce("own_licence", "_near._licence").alias("licence"), F.when(inherits, F.col("_near._dir")).alias("inherited_from"))
