"""License notices found by conditional compression (operator 4)."""

from __future__ import annotations

import bisect
import difflib
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from panelspark.llm.common import small_batches, table, texts

#: Names and wordings of notices. Other tables (name: wording) may be given to `scan`.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved": "All rights reserved.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-or-Apache-2.0": "Apache License, Version 2.0 or the MIT License",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "MIT-terms": "This project is licensed under the terms of the MIT license.",
    "MIT-title": "MIT License Copyright (c)",
    "Apache-2.0-title": "Apache License Version 2.0, January 2004",
    "GPL-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "AGPL-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "GPL-2.0-short": "Released under the GPLv2 license.",
    "GPL-3.0-short": "Released under the GPLv3 license.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC0-1.0-deed": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    "CC0-1.0-title": "CC0 1.0 Universal Public Domain Dedication",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    **{f"SPDX-{k}": f"SPDX-License-Identifier: {k}" for k in ("MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "CC0-1.0", "Unlicense", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "EPL-1.0", "EPL-2.0", "BSL-1.0", "Zlib", "0BSD", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0")},
    **{f"{k}-{n}": f"This work is licensed under the GNU {name} General Public License, version {n[0] if n.endswith('.0') else n}." for k, name, n in (("LGPL", "Lesser", "2.1"), ("LGPL", "Lesser", "3.0"), ("AGPL", "Affero", "3.0"))},
}
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _k, _name in CC.items():
    for _v, _form in (("4.0", "International"), ("3.0", "Unported")):
        TEMPLATES.setdefault(f"CC-{_k}-{_v}" + ("-long" if (_k, _v) == ("BY-NC", "4.0") else ""), f"This work is licensed under a Creative Commons {_name} {_v} {_form} License.")
        TEMPLATES.setdefault(f"CC-{_k}-{_v}" + ("" if (_k, _v) == ("BY-NC", "4.0") else "-short"), f"Licensed under CC {_k} {_v}.")
#: Words around these are candidates; every template holds one.
CUE = re.compile(r"licen[sc]|copyright|\(c\)|©|rights\s+reserved|permission\s+(?:is|to)|redistribut|spdx|free\s+software|public\s+domain|unencumbered|neighbou?ring\s+rights", re.IGNORECASE)
WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
#: Spellings that count as the same word, as in public guidelines for matching licences.
SAME = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "organisation": "organization"}
#: The least share of a template's words that a text must hold in order, and the most words of it between them, as a share.
LEAST_HELD, MOST_BETWEEN = 0.9, 0.35
#: Words that tell licences apart: a difference that touches one, or a number, is another licence.
TELLING = {"not", "by", "nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike", "lesser", "library", "affero", "apache", "mit", "mozilla", "cc", "gnu"}
#: Words before a notice, in its clause and at most so many words back, by which it says what doesn't hold.
DENYING, BACK = {"not", "no", "never", "none", "neither", "nor", "cannot", "without", "isn", "aren", "wasn", "weren", "doesn", "don"}, 6
CLAUSE = re.compile(r"[.;:!?,]|\n\s*\n")
#: A tag with an expression of identifiers, and the parts of an expression.
TAG = re.compile(r"SPDX[-\s]*License[-\s]*Identifier\s*:?\s*([^\n]*)", re.IGNORECASE)
PART = re.compile(r"\s*(?:(AND|OR|WITH)\b|([()])|([A-Za-z0-9][A-Za-z0-9.+-]*))")
#: Longest block, in words, that a worker remembers, and how many blocks.
BLOCK, CACHE = 60, 20_000
#: zstandard's level; and the least size reduction of a winner, as a share of what its template takes off itself.
LEVEL, LEAST_SAVED = 3, 0.1


def words(text: str) -> list[str]:
    return [SAME.get(w, w) for w in WORD.findall(text.lower())]


def telling(word: str) -> bool:
    return word in TELLING or word.lstrip("v")[:1].isdigit()


def identifiers(expression: str) -> list[str]:
    """The licences of an expression as "(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0": identifiers joined
    by operators, without exceptions, up to what isn't part of it."""
    out, at, joined = [], 0, "OR"
    while m := PART.match(expression, at):
        operator, bracket, name = m.groups()
        if name and not joined:
            break
        if name and joined != "WITH":
            out.append(name.rstrip("."))
        joined, at = operator if operator else joined if bracket else "", m.end()
    return out


class Template:
    """A notice's words, their counts, words that it can begin with, least words held, longest notice in words; and the
    compressor that has it as a raw dictionary, with the bytes that it takes off itself. Texts are compressed as words in
    lower case, one space apart, so that layout doesn't count."""

    def __init__(self, text: str):
        self.words = words(text)
        n = len(self.words)
        self.counts, self.least, self.span = Counter(self.words), math.ceil(LEAST_HELD * n), n + int(MOST_BETWEEN * n)
        self.begins = set(self.words[: n - self.least + 1])
        data = " ".join(self.words).encode()
        raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=raw)
        self.own = len(plain().compress(data)) - len(self.compressor.compress(data))


@lru_cache(1)
def plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)


class Matcher:
    """The templates by name, in classes of about the same length: a block around a cue is as wide as the longest notice of
    its class, so that a notice is no small part of it. Remembers what was found in blocks."""

    def __init__(self, templates: dict[str, str]):
        self.templates = {k: Template(v) for k, v in templates.items()}
        self.tags = [k for k, x in self.templates.items() if x.words[:3] == ["spdx", "license", "identifier"]]
        self.classes: list[tuple[int, list[str]]] = []
        for k in sorted(self.templates, key=lambda k: (self.templates[k].span, k)):
            if not self.classes or self.templates[k].span > 1.5 * self.templates[self.classes[-1][1][0]].span:
                self.classes.append((0, []))
            self.classes[-1] = self.templates[k].span, [*self.classes[-1][1], k]
        self.remembered = lru_cache(CACHE)(self.notices)

    def ranked(self, have: tuple[str, ...], names: list[str]) -> list[tuple[int, str]]:
        """(bytes saved, name) of the templates that, as raw dictionaries, take enough off a block's compressed words; largest
        reduction first."""
        data = " ".join(have).encode()
        size = len(plain().compress(data))
        saved = [(size - len(self.templates[k].compressor.compress(data)), k) for k in names]
        return sorted((x for x in saved if x[0] >= LEAST_SAVED * self.templates[x[1]].own), key=lambda x: (-x[0], x[1]))

    def notices(self, kind: int, have: tuple[str, ...]) -> list[tuple]:
        """(name, bytes saved, difference, first word, end, words held, words more, the differences) of each notice of a class (-1:
        of the tags) in a block, in order of the size reduction of its template, where the exact wording confirms it."""
        return [(name, saved, *x) for saved, name in self.ranked(have, self.tags if kind < 0 else self.classes[kind][1]) for x in self.confirmed(name, have)]

    def confirmed(self, name: str, have: tuple[str, ...]) -> list[tuple]:
        """The places at which a template's wording stands: enough of its words in order, few others between them, and no
        difference in words that tell licences apart. Of places that overlap the one of least difference."""
        x = self.templates[name]
        if sum((x.counts & Counter(have)).values()) < x.least:
            return []
        passed = []
        for i in (i for i, w in enumerate(have) if w in x.begins):
            near = have[i : i + x.span]
            if sum((x.counts & Counter(near)).values()) < x.least:
                continue
            same = [m for m in difflib.SequenceMatcher(None, x.words, near, False).get_matching_blocks() if m.size]
            held, first, last = sum(m.size for m in same), same[0].b, same[-1].b + same[-1].size
            between = last - first - held
            if held >= x.least and between <= MOST_BETWEEN * len(x.words):
                taken = {k for m in same for k in range(m.a, m.a + m.size)}
                used = {k for m in same for k in range(m.b, m.b + m.size)}
                missing, more = [w for k, w in enumerate(x.words) if k not in taken], [near[k] for k in range(first, last) if k not in used]
                if not any(map(telling, missing + more)):
                    passed.append((len(missing) + between, i + first, i + last, held, between, " ".join([*(f"-{w}" for w in missing), *(f"+{w}" for w in more)])))
        return apart(passed)

    def found(self, text: str) -> tuple[int, list[tuple[str, int, float, int, int, str]]]:
        """The number of candidate blocks of the widest class, and (license, bytes saved, share of the template's words held, words
        missing, words more, the differences) of each notice of a text.

        Blocks are the words around cues as far as the class reaches, across lines and sentences; those that overlap are one,
        which is looked at in pieces of some reaches that overlap by one. Each identifier of a tag's expression is besides a
        block of its own with the tag's words. A notice that its clause denies is none."""
        cues = [m.span() for m in CUE.finditer(text)]
        if not cues:
            return 0, []
        at = [m.span() for m in WORD.finditer(text)]
        starts, ends = [a for a, _ in at], [b for _, b in at]
        have = [SAME.get(w, w) for w in (text[a:b].lower() for a, b in at)]
        by_name: dict[str, list[tuple]] = {}
        spans: list[list[int]] = []
        for kind, (far, _) in enumerate(self.classes):
            spans = []
            for a, b in cues:
                lo, hi = max(0, bisect.bisect_right(ends, a) - far), min(len(at), bisect.bisect_left(starts, b) + far)
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = hi
                elif lo < hi:
                    spans.append([lo, hi])
            for lo, hi in spans:
                for first in range(lo, max(hi - far, lo + 1), 3 * far):
                    piece = tuple(have[first : min(first + 4 * far, hi)])
                    for name, saved, off, start, end, *rest in self.remembered(kind, piece) if len(piece) <= BLOCK else self.notices(kind, piece):
                        by_name.setdefault(name, []).append((off, first + start, first + end, saved, *rest))
        for m in TAG.finditer(text):
            first = bisect.bisect_left(starts, m.start())
            for one in dict.fromkeys(identifiers(m.group(1))):
                for name, saved, off, start, end, *rest in self.remembered(-1, ("spdx", "license", "identifier", *words(one))):
                    by_name.setdefault(name, []).append((off, first + start, first + end, saved, *rest))
        out = []
        for name in list(by_name):
            by_name[name] = [p for p in by_name[name] if not denied(text, at, p[1])]
        for name, places in by_name.items():
            n = len(self.templates[name].words)
            out += [(name, saved, held / n, n - held, more, differences) for _, _, _, saved, held, more, differences in apart(places)]
        return len(spans), sorted(out, key=lambda x: (-x[1], x[0]))


def denied(text: str, at: list[tuple[int, int]], first: int) -> bool:
    """Whether the clause before word `first` says that what follows doesn't hold."""
    before = text[at[max(0, first - BACK)][0] : at[first][0]]
    return any(w in DENYING for w in words(CLAUSE.split(before)[-1]))


def apart(places: list[tuple]) -> list[tuple]:
    """Of (difference, first, end, ...) that overlap the one of least difference, then the first; in order of place. Those chosen
    are kept sorted by place, so each is compared with the one before its end alone."""
    starts: list[int] = []
    chosen: list[tuple] = []
    for y in sorted(places):
        k = bisect.bisect_left(starts, y[2])
        if not k or chosen[k - 1][2] <= y[1]:
            k = bisect.bisect_left(starts, y[1])
            starts.insert(k, y[1])
            chosen.insert(k, y)
    return chosen


@lru_cache(4)
def matcher(templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES.items())) -> Matcher:
    return Matcher(dict(templates))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row for each document: doc_id, n_blocks (candidate blocks), n_found (notices), licenses (names, sorted, once each), best
    (that of the most bytes saved, null if none), saved, held, missing, more and differences of the best.

    A null or empty text has no blocks. Repeated rows give repeated rows, an empty table none. Other columns aren't read. Of
    equal savings the lesser name is best. Very long texts with very many notices take time in proportion to their number.
    Whole texts are read; each block around a cue is compressed with every template, and winners are confirmed by wording.
    """
    given = tuple(templates.items())
    schema = pa.schema([("doc_id", pa.int64()), ("n_blocks", pa.int64()), ("n_found", pa.int64()), ("licenses", pa.list_(pa.string())), ("best", pa.string()), ("saved", pa.int64()), ("held", pa.float64()), ("missing", pa.int64()), ("more", pa.int64()), ("differences", pa.string())])

    def run(batches):
        of = matcher(given)
        for batch in small_batches(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                n_blocks, found = of.found(text)
                best = min(found, key=lambda x: (-x[1], x[0])) if found else (None,) * 6
                rows.append(dict(zip(schema.names, (doc_id, n_blocks, len(found), sorted({x[0] for x in found}), *best))))
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_blocks long, n_found long, licenses array<string>, best string, saved long, held double, missing long, more long, differences string")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
