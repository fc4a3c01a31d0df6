"""License scan by conditional compression (operator 6).

A template is cut in one more pieces than its differing words can spoil: each word that is missing and each that is added spoils one
at most. So every occurrence has a whole piece, and an Aho-Corasick automaton finds all of them in one pass: a document's candidate
blocks are the words around them, and no occurrence is outside. Each block is compressed alone
and with each template as a raw Zstandard dictionary; the bytes that a template saves, as a share of what it costs to say the
template itself, rank the templates. Saved bytes shrink where a block repeats itself, so they only order: all templates of which
a block has enough words, in any order, are confirmed, best first, by exact wording: the words of the template are aligned with
the block's, and words that are missing, added or replaced inside the matched span are counted. A template is found where
they are at most DIFFERING of its words. Of overlapping finds, the one with fewer differing words stays (ties: the longer template,
then the name).

Blocks are cut for short notices, headers and whole texts apart, so that each has a width that fits its templates; they overlap by
the longest template, so each occurrence lies whole in one, and their size is bounded whatever the text.

Results: words are runs of letters and digits in lower case. Null and empty texts, and texts without a piece, have no
finds. Repeated rows are scanned alike, and each occurrence in a text is a find. Columns of the input with the name of a new
column are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import append_columns

WORD = re.compile(r"[^\W_]+")
OTHERS = re.compile(r"[\W_]+")
DIFFERING = 0.1
#: A level whose search finds short repeats, at any place of the dictionary.
LEVEL = 19
_GNU = (
    "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation{}{}{}"
)
_LATER = " of the License, or (at your option) any later version."
_OFFICE = "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA "
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Notices and texts by which works are put under public licenses (name, wording).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to this work to the public domain worldwide."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy "
        "of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", _GNU.format("program", ":", "General", ",", " either version 3", _LATER)),
    ("GPL-2.0", _GNU.format("program", ";", "General", ";", " either version 2", _LATER)),
    ("GPL-2.0", _GNU.format("program", ";", "General", ";", " version 2", " of the License.")),
    ("AGPL-3.0", _GNU.format("program", ":", "Affero General", ",", " either version 3", _LATER)),
    ("LGPL-3.0", _GNU.format("library", ":", "Lesser General", ",", " either version 3", _LATER)),
    ("LGPL-2.1", _GNU.format("library", ";", "Lesser General", ";", " either version 2.1", _LATER)),
    ("LGPL-2.0", _GNU.format("library", ";", "Library General", ";", " either version 2", _LATER)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _VERBATIM),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., " + _OFFICE + _VERBATIM),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _VERBATIM),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. " + _OFFICE + _VERBATIM),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _VERBATIM),
    ("BSD-2-Clause", _BSD + _DISCLAIMER),
    (
        "BSD-3-Clause",
        _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. " + _DISCLAIMER,
    ),
)
#: Templates of more words are headers, and of more than WHOLE_WORDS whole texts.
NOTICE_WORDS = 24
WHOLE_WORDS = 120


@dataclass
class Template:
    name: str
    words: list[str]
    counts: Counter[str]
    cost: int = 0
    compressor: object = None


@dataclass
class Group:
    """Templates of about one length; width is the longest one's words and what may be added to it."""

    templates: list[Template] = field(default_factory=list)
    width: int = 0


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, differing: float = DIFFERING):
        import ahocorasick
        import zstandard

        self.differing = differing
        #: By piece: the kinds of template that have it, with the words around it that may be the template's, of each kind the widest.
        near: dict[str, dict[int, tuple[int, int]]] = {}
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.groups = [Group(), Group(), Group()]
        for name, wording in templates:
            words = WORD.findall(wording.lower())
            data = " ".join(words).encode()
            raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            template = Template(name, words, Counter(words), compressor=zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False))
            template.cost = max(1, len(self.plain.compress(data)) - len(template.compressor.compress(data)))
            kind, most = (len(words) > NOTICE_WORDS) + (len(words) > WHOLE_WORDS), int(differing * len(words))
            group = self.groups[kind]
            group.templates.append(template)
            group.width = max(group.width, len(words) + most + 1)
            parts = 2 * most + 1
            for i in range(parts):
                a, z = len(words) * i // parts, len(words) * (i + 1) // parts
                piece = f" {' '.join(words[a:z])} "
                first, last = -a - most, len(words) + 2 * most - a
                x, y = near.setdefault(piece, {}).get(kind, (first, last))
                near[piece][kind] = min(first, x), max(last, y)
        self.automaton = ahocorasick.Automaton()
        for piece, kinds in near.items():
            self.automaton.add_word(piece, (len(piece), tuple(kinds.items())))
        self.automaton.make_automaton()

    def blocks(self, around: list[tuple[int, int]], n: int, width: int) -> list[tuple[int, int]]:
        """The ranges of words, in pieces of at most 4 * width; neighbours overlap by width."""
        runs: list[list[int]] = []
        for a, z in sorted(around):
            a, z = max(0, a), min(n, z)
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(z, runs[-1][1])
            else:
                runs.append([a, z])
        return [(k, min(k + 4 * width, z)) for a, z in runs for k in range(a, max(a + 1, z - width), 3 * width)]

    def scan(self, text: str | None) -> list[tuple[str, int, int, int]]:
        """(name, first character, character after the last, differing words) of each find, ascending."""
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):  # places are the text's
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        spaced = f" {OTHERS.sub(' ', low).strip()} "
        hits = list(self.automaton.iter(spaced))
        if not hits:
            return []
        found = list(WORD.finditer(low))
        words = [m.group() for m in found]
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])  # of the space before each word
        around: list[list[tuple[int, int]]] = [[] for _ in self.groups]
        for p, (end, (size, kinds)) in zip(np.searchsorted(starts, [end - size + 1 for end, (size, _) in hits]).tolist(), hits):
            for kind, (a, z) in kinds:
                around[kind].append((p + a, p + z))
        finds: set[tuple[int, int, int, int, str]] = set()
        for group, near in zip(self.groups, around):
            for a, z in self.blocks(near, len(words), group.width):
                block = words[a:z]
                for t in self.ranked(group, block):
                    finds.update((d, -len(t.words), a + i, a + j, t.name) for d, i, j in self.confirm(t, block))
        out: list[tuple[str, int, int, int]] = []
        taken: list[tuple[int, int]] = []
        for d, _, i, j, name in sorted(finds):
            if all(j <= x or i >= y for x, y in taken):
                taken.append((i, j))
                out.append((name, found[i].start(), found[j - 1].end(), d))
        return sorted(out, key=lambda f: f[1])

    def ranked(self, group: Group, block: list[str]) -> list[Template]:
        """The templates that may be in the block, by what they save it as a share of what they are long; ties in their given order."""
        held = Counter(block)
        may = [t for t in group.templates if (t.counts & held).total() >= len(t.words) - int(self.differing * len(t.words))]
        if len(may) < 2:
            return may
        data = " ".join(block).encode()
        alone = len(self.plain.compress(data))
        return sorted(may, key=lambda t: (len(t.compressor.compress(data)) - alone) / t.cost)

    def confirm(self, t: Template, block: list[str]) -> list[tuple[int, int, int]]:
        """(differing words, first word, word after the last) of the template's occurrences in the block."""
        n, most = len(t.words), int(self.differing * len(t.words))
        first = set(t.words[: most + 1])
        out, a = [], 0
        while a < len(block):
            # an occurrence starts at one of the template's first words, as no more than `most` are missing
            start = next((i for i in range(a, len(block)) if block[i] in first), None)
            if start is None:
                break
            part = block[start : start + n + most]
            if (t.counts & Counter(part)).total() < n - most:  # no alignment can match more
                a = start + 1
                continue
            matched = [m for m in SequenceMatcher(None, t.words, part, autojunk=False).get_matching_blocks() if m.size]
            best = None
            for k in range(len(matched), 0, -1):  # words after the last match aren't the find's
                end = matched[k - 1].b + matched[k - 1].size
                same = sum(m.size for m in matched[:k])
                differ = max(n, end) - same
                if best is None or differ < best[0]:
                    best = (differ, start, start + end)
            if best and best[0] <= most:
                out.append(best)
                a = best[2]
            else:
                a = start + 1
        return out


@lru_cache(1)
def _scanner() -> Scanner:
    return Scanner()


FIELDS = "licenses array<struct<name: string, first: bigint, end: bigint, differing: bigint>>"


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with licenses: name, place (characters, from 0) and differing words of each find."""
    kind = pa.list_(pa.struct([("name", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("differing", pa.int64())]))

    def run(texts: pa.Array) -> pa.Array:
        s = _scanner()
        finds = [[{"name": n, "first": a, "end": z, "differing": d} for n, a, z, d in s.scan(t.as_py())] for t in texts]
        return pa.StructArray.from_arrays([pa.array(finds, kind)], ["licenses"])

    return append_columns(docs, [text_col], run, FIELDS)
