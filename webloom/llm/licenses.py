"""License scan by conditional compression.

Candidate blocks are the words at most REACH words from a license word, however the lines are wrapped; REACH is more than
any template's occurrence is long, so a block holds every occurrence whole. A run of over WINDOW + REACH words is cut into
blocks that overlap by REACH words, and an occurrence belongs to the block in whose first WINDOW words it starts. A block
is compressed by zstandard alone and with each template as raw dictionary; the relative reductions rank the templates. They are
compared by exact wording down the ranking, and the first that is confirmed decides: only templates whose reduction is within TIE
of its own are compared too, and of these the one with fewest differences wins (then the longest, then the first by name). The words
that it covers are taken out before the next. A confirmed occurrence shares SEED consecutive words with its template (see there), so
each such place is aligned: words of the template that are missing and block words inside the aligned part that the template
doesn't have are counted; a template is confirmed if both are at most DIFF of its length and no missing or extra word is a
number, a version or a word that changes the terms. Titles count only where they stand alone in a line. SPDX tags have a grammar
of their own and are read by it first, as whole expressions (AND, OR, WITH, +, brackets).

Edge cases: null and empty texts have no blocks; a block without confirmed template counts in n_blocks only; rows are
independent, so repeated rows get equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import map_slices

WINDOW, DIFF = 600, 0.1
#: Reductions this close don't rank templates against each other.
TIE = 0.06
#: With d = DIFF * n missing and d extra words, the other n - d words of a template of n words stand in at most 2 * d + 1 runs;
#: the longest has at least three words.
SEED = 3
LEVEL = 6

#: Wording of licenses and of the notices that refer to them.
GRANT_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
GRANT_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies."
)
BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution."
)
BSD_3 = BSD_2 + (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by "
    "the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
)
MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
)
UNLICENSE = "This is free and unencumbered software released into the public domain."
BOOST = "Distributed under the Boost Software License, Version 1.0."

WARRANTY_MIT = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
WARRANTY_BSD = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

GNU_NAMES = (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"))
CC_KINDS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
CC_WORDS = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
SUBJECTS = ("This work is licensed", "Licensed", "Released", "Available", "Distributed", "Released under the terms of the", "This project is licensed", "This software is licensed")
DUAL = ("MIT", "Apache-2.0", "BSD-3-Clause", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")
#: How full texts begin, and short names.
VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
OPENINGS = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA {VERBATIM}"),
    ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {VERBATIM}"),
    ("LGPL-2.1", f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA {VERBATIM}"),
    ("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {VERBATIM}"),
    ("AGPL-3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {VERBATIM}"),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
)
SHORT = {
    "MIT": ("MIT",), "ISC": ("ISC",), "Apache-2.0": ("Apache 2.0", "Apache License 2.0", "Apache-2.0"), "MPL-2.0": ("MPL 2.0", "MPL-2.0", "Mozilla Public License 2.0"),
    "GPL-2.0": ("GPLv2", "GPL v2", "GPL-2.0", "GNU GPLv2"), "GPL-3.0": ("GPLv3", "GPL v3", "GPL-3.0", "GNU GPLv3"), "LGPL-2.1": ("LGPLv2.1", "LGPL-2.1"), "LGPL-3.0": ("LGPLv3", "LGPL-3.0"),
    "AGPL-3.0": ("AGPLv3", "AGPL-3.0"), "BSD-2-Clause": ("BSD 2-Clause", "BSD-2-Clause"), "BSD-3-Clause": ("BSD 3-Clause", "BSD-3-Clause"), "CC0-1.0": ("CC0", "CC0 1.0", "CC0-1.0", "CC0 1.0 Universal"),
    "EPL-2.0": ("EPL-2.0", "EPL 2.0", "Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"), "Zlib": ("zlib",),
}


def templates() -> list[tuple[str, str]]:
    """(license, wording): grants with and without their warranty parts, how full texts begin, and the short notices built from names by
    rule. A wording between line ends is a title."""
    out = [
        ("MIT", GRANT_MIT), ("MIT", f"{GRANT_MIT} {WARRANTY_MIT}"), ("ISC", GRANT_ISC), ("BSD-2-Clause", BSD_2), ("BSD-2-Clause", f"{BSD_2} {WARRANTY_BSD}"),
        ("BSD-3-Clause", BSD_3), ("BSD-3-Clause", f"{BSD_3} {WARRANTY_BSD}"), ("Apache-2.0", APACHE), ("MPL-2.0", MPL), ("Unlicense", UNLICENSE), ("BSL-1.0", BOOST), *OPENINGS,
    ]
    out += [(name, GNU.format(adjective, version)) for name, adjective, version in GNU_NAMES]
    short = [("MIT", "MIT License"), ("ISC", "ISC License"), ("Apache-2.0", "Apache License, Version 2.0"), ("MPL-2.0", "Mozilla Public License, version 2.0")]
    short += [(n, f"GNU {a}General Public License, version {v}") for n, a, v in GNU_NAMES]
    short += [(f"BSD-{n}-Clause", f"BSD {n}-Clause License") for n in (2, 3)]
    plain = [(f"CC-{k}-{v}", f"CC {k} {v}") for k in CC_KINDS for v in CC_VERSIONS]
    spelled = [(f"CC-{k}-{v}", f"Creative Commons {'-'.join(CC_WORDS[x] for x in k.split('-'))} {v} International License") for k in CC_KINDS for v in CC_VERSIONS]
    brief = [(name, title) for name, titles in SHORT.items() for title in titles]
    for subject in SUBJECTS:
        after = "" if subject.endswith("terms of the") else " under the"
        out += [(name, f"{subject}{after} {title}.") for name, title in short]
        out += [(name, f"{subject}{after} {title} license.") for name, title in brief]
        if after:
            out += [(name, f"{subject} under {title}.") for name, title in [*plain, *brief]]
            out += [(name, f"{subject}{after} {title}.") for name, title in brief]
    out += [(name, f"{subject} under a {title}.") for subject in ("This work is licensed", "Licensed") for name, title in spelled]
    out += [(name, f"License: {title}{tail}") for name, title in brief for tail in ("", " License")]
    out += [(name, f"\n{title}\n") for name, title in short] + [(name, f"\n{title} License\n") for name, title in brief if "License" not in title]
    named = dict(short)
    out += [(f"{a} OR {b}", f"{subject} under either of {named[a]} or {named[b]}") for subject in ("Licensed", "This project is licensed") for a in DUAL for b in DUAL if a != b]
    out += [(f"{a} AND {b}", f"Dual licensed under {a} and {b}.") for a in DUAL for b in DUAL if a != b]
    return list(dict.fromkeys(out))


SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*", re.I)
SPDX_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\+?)")


def spdx_expression(text: str, at: int) -> tuple[str, int] | None:
    """The longest whole expression at a place, written in the usual way, and its end."""
    tokens, depth, operand, found = [], 0, True, None
    while m := SPDX_TOKEN.match(text, at):
        t = m[1]
        if operand and t == "(":
            depth += 1
        elif operand and t not in (")", "AND", "OR", "WITH") and re.search("[A-Za-z]", t):
            operand = False
        elif not operand and t == ")" and depth:
            depth -= 1
        elif not operand and t in ("AND", "OR", "WITH"):
            operand = True
        else:
            break
        tokens.append(t)
        at = m.end()
        if not operand and not depth:
            found = " ".join(tokens).replace("( ", "(").replace(" )", ")"), at
    return found


HINTS = ("licen", "released under", "distributed under", "available under", "copyright", "permission", "redistribut", "public domain", "public license", "creative commons", "warrant", "spdx")
HINT = re.compile("|".join(r"\W+".join(h.split()) for h in HINTS), re.I)
#: A line may end after a hyphen within a word; the next line may begin with marks of a comment.
BROKEN = r"-[ \t]*\r?\n[ \t*#/;%>|]*"
WORD = re.compile(rf"[\w.+/-]*\w(?:{BROKEN}[\w.+/-]*\w)*")
#: A difference in one of these is never a slip: numbers, versions, and words that change the terms.
TELLING = re.compile(r"\d|^(?:not?|non\w*|without|except|by(?:-\w+)*|lesser|affero|mit|isc|bsd|apache|mozilla|boost|gnu|eclipse|zlib)$")


def words_of(text: str) -> list[str]:
    return [whole(w) for w in WORD.findall(text)]


def whole(word: str) -> str:
    return (re.sub(BROKEN, "-", word) if "\n" in word else word).lower()


REACH = max(len(words_of(t)) + 2 * int(DIFF * len(words_of(t))) for _, t in templates())


def candidate_blocks(text: str | None) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Code points of all words, and the blocks as words [start, end) with the end of the part in which occurrences start."""
    low = (text or "").lower()
    if not text or not any(h.split()[0] in low for h in HINTS) or not HINT.search(text):
        return [], []
    places = [m.span() for m in WORD.finditer(text)]
    starts, runs = [a for a, _ in places], []
    for m in HINT.finditer(text):
        k = bisect_right(starts, m.start()) - 1
        a, b = max(0, k - REACH), min(len(places), k + REACH + 1)
        if runs and a <= runs[-1][1]:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    out = []
    for a, b in runs:
        while b - a > WINDOW + REACH:
            out.append((a, a + WINDOW, a + WINDOW + REACH))
            a += WINDOW
        out.append((a, b, b))
    return places, out


class Scanner:
    def __init__(self):
        self.names = templates()
        self.titles = {k for k, (_, t) in enumerate(self.names) if t[0] == "\n"}
        self.words = [words_of(t) for _, t in self.names]
        self.counts = [Counter(w) for w in self.words]
        self.seeds: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        for k, own in enumerate(self.words):
            n = min(SEED, len(own))
            for j in range(len(own) - n + 1):
                self.seeds.setdefault(tuple(own[j : j + n]), []).append((k, j))
        kw = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = zstandard.ZstdCompressor(**kw)
        raw = [zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, t in self.names]
        self.with_dict = [zstandard.ZstdCompressor(dict_data=d, **kw) for d in raw]

    def ranked(self, block: str, which) -> list[tuple[float, int]]:
        """(relative reduction, template) of templates, best first; those that lack a seed or too many words can't be confirmed."""
        data = block.encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(data))
        gains = [(1 - len(c.compress(data)) / alone, k) for k, c in ((k, self.with_dict[k]) for k in which)]
        return sorted(gains, key=lambda x: (-x[0], x[1]))

    def offsets(self, words: list[str]) -> dict[int, set[int]]:
        """Of every template that shares SEED words with the block: where its first word would stand."""
        out: dict[int, set[int]] = {}
        for n in range(1, SEED + 1):
            for i, gram in enumerate(zip(*(words[i:] for i in range(n)), strict=False)):
                for k, j in self.seeds.get(gram, ()):
                    out.setdefault(k, set()).add(i - j)
        return out

    def compare(self, words: list[str], k: int, offsets: set[int]) -> list[tuple[int, int, int, int]]:
        """Missing and extra words, and the aligned part of the block, at each place where the wording is the template's."""
        size = len(self.words[k])
        slack, out = int(DIFF * size), set()
        for offset in sorted(offsets):
            at = max(0, offset - slack)
            if c := self._aligned(words[at : max(0, offset + size + slack)], k, slack):
                out.add((c[0], c[1], at + c[2], at + c[3]))
        return sorted(out)

    def _aligned(self, words: list[str], k: int, slack: int) -> tuple[int, int, int, int] | None:
        own = self.words[k]
        if (self.counts[k] & Counter(words)).total() < len(own) - slack:
            return None
        same = [b for b in SequenceMatcher(None, words, own, autojunk=False).get_matching_blocks() if b.size]
        best, score, first = (0, 0, 0), 0, 0  # the neighbours in words with the most common words less those between
        for i, x in enumerate(same):
            score -= x.a - same[i - 1].a - same[i - 1].size if i else 0
            if score < 0:
                score, first = 0, i
            score += x.size
            if score >= best[0]:
                best = score, first, i + 1
        same = same[best[1] : best[2]]
        a, b = same[0].a, same[-1].a + same[-1].size
        inside, matched = {i for x in same for i in range(x.a, x.a + x.size)}, {i for x in same for i in range(x.b, x.b + x.size)}
        extra = [words[i] for i in range(a, b) if i not in inside]
        missing = [own[i] for i in range(len(own)) if i not in matched]
        if max(len(extra), len(missing)) > slack or any(TELLING.search(w) for w in extra + missing):
            return None
        return len(missing), len(extra), a, b

    def winner(self, block: str, words: list[str], fits: Callable, tie: float = TIE) -> tuple | None:
        """(differences, -length, license, reduction, comparison, template) of the template that the ranking and the wording decide on."""
        offsets, present = self.offsets(words), set(words)
        possible = [k for k in sorted(offsets) if sum(w not in present for w in self.words[k]) <= int(DIFF * len(self.words[k]))]
        sure: list[tuple] = []
        for gain, k in self.ranked(block, possible):
            if sure and gain < sure[0][3] - tie:
                break
            sure += [(c[0] + c[1], -len(self.words[k]), self.names[k][0], gain, c, k) for c in self.compare(words, k, offsets[k]) if fits(k, c)]
        return min(sure) if sure else None

    def scan(self, text: str | None, tie: float = TIE) -> tuple[int, list[dict]]:
        places, blocks = candidate_blocks(text)
        lower, taken, found = [whole(text[a:b]) for a, b in places], [False] * len(places), []
        starts = [a for a, _ in places]
        for m in SPDX.finditer(text) if blocks else ():
            if got := spdx_expression(text, m.end()):
                known = [k for k, (name, _) in enumerate(self.names) if name == re.match(r"\(*([^ ()+]*)", got[0])[1]]
                gains = self.ranked(text[m.start() : got[1]], known[:1])
                found.append({"license": got[0], "start": m.start(), "end": got[1], "reduction": round(gains[0][0], 6) if gains else 0.0, "missing": 0, "extra": 0})
                for i in range(bisect_left(starts, m.start()), bisect_left(starts, got[1])):
                    taken[i] = True

        def alone(s: int, e: int) -> bool:
            before, after = text[text.rfind("\n", 0, s) + 1 : s], text[e : (text + "\n").index("\n", e)]
            return not re.search(r"\w", before) and not re.search(r"\w", after)

        for first, core, last in blocks:
            while live := [i for i in range(first, last) if not taken[i]]:
                block, at = [], places[first][0]
                for i in range(first, last):
                    block += [" "] * (places[i][1] - at) if taken[i] else [text[at : places[i][1]]]
                    at = places[i][1]
                fits = lambda k, c: live[c[2]] < core and (k not in self.titles or alone(places[live[c[2]]][0], places[live[c[3] - 1]][1]))  # noqa: B023, E731
                best = self.winner("".join(block), [lower[i] for i in live], fits, tie)
                if best is None:
                    break
                _, _, name, gain, (missing, extra, a, b), _ = best
                s, e = places[live[a]][0], places[live[b - 1]][1]
                found.append({"license": name, "start": s, "end": e, "reduction": round(gain, 6), "missing": missing, "extra": extra})
                for i in live[a:b]:
                    taken[i] = True
        return len(blocks), sorted(found, key=lambda x: (x["start"], x["license"]))


SCHEMA = "doc_id bigint, n_blocks bigint, found array<struct<license:string,start:int,end:int,reduction:double,missing:int,extra:int>>"


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, number of candidate blocks, and the confirmed licenses with places and differences."""

    def make():
        scanner = Scanner()

        def f(cols):
            got = [scanner.scan(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "n_blocks": [n for n, _ in got], "found": [x for _, x in got]}

        return f

    return map_slices(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), "text", make, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: licenses of every document."""
    out = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"])))
    return out.select(
        "doc_id", "n_blocks", F.size("found").cast("bigint").alias("n_found"), F.array_join(names, ",").alias("licenses"),
        F.array_max(F.transform("found", lambda x: x["reduction"])).alias("best_reduction"),
    )
