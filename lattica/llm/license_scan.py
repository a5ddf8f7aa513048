"""License scans by patience alignment.

A text is aligned with a license template on anchors, words that occur once in both; the longest increasing
subsequence of the anchors' positions is kept and the gaps between them are aligned in the same way, with the
words that are unique within the gap.  Coverage is the share of the template's words that are matched.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import prepare
from lattica.llm.decontaminate import word_codes
from lattica.llm.text import chunks

# Public license notices, as they stand at the head or the foot of a text.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
}
#: Text words that a match may spread over, in template lengths.
SPREAD = 2


def longest_increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence (patience sorting)."""
    tops: list[int] = []
    tails: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before[i] = tails[k - 1] if k else -1
        tops[k : k + 1], tails[k : k + 1] = [v], [i]
    out, i = [], tails[-1] if tails else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched (text, template) positions of a recursive patience alignment, in order."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_text, in_template = Counter(text[a0:a1]), Counter(template[b0:b1])
        at = {w: i for i, w in enumerate(text[a0:a1], a0) if in_text[w] == 1}
        anchors = [(at[w], j) for j, w in enumerate(template[b0:b1], b0) if in_template[w] == 1 and w in at]
        if not anchors:
            continue
        kept = [anchors[k] for k in longest_increasing([a for a, _ in anchors])]
        out += kept
        edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


def needed(words: int, coverage: float) -> int:
    """Template words that make up the coverage; whole numbers, since (1 - 0.8) * 5 is less than 1."""
    return ceil(coverage * words - 1e-9)


def shared_words(text: list[int], template: list[int], size: int) -> np.ndarray:
    """For each start, how many words (repeats counted) the next ``size`` words share with the template; one word comes and goes a step."""
    left, held, out = dict(Counter(template)), 0, np.zeros(len(text), np.int64)
    for k, w in enumerate(text):
        if w in left:
            held += left[w] > 0
            left[w] -= 1
        start = k - size + 1
        if start >= 0:
            out[start] = held
            gone = text[start]
            if gone in left:
                left[gone] += 1
                held -= left[gone] > 0
    for start in range(max(0, len(text) - size + 1), len(text)):
        out[start] = held
        if text[start] in left:
            left[text[start]] += 1
            held -= left[text[start]] > 0
    return out


def find(text: list[int], template: list[int], first: list[int], least: int = 1) -> tuple[float, int, int]:
    """Best coverage of a template in a text and the word span of it.

    ``first`` has the text positions of template words that are rare in the template set.  The first copy that is
    word for word the template's is the result if there is one.  Else a stretch of ``SPREAD`` template lengths on
    either side of each mark is aligned (overlapping stretches once).  Where none has ``least`` words, as beside a
    second copy that leaves no word unique, shorter stretches at each mark are aligned: from the start that the mark
    has in the template and from every shift that ``len(template) - least`` allows.  Of equal coverages the one that
    starts first counts, then the shorter one.
    """
    reach, best, done = SPREAD * len(template), (0, 0, 0), -1
    places: dict[int, list[int]] = {}
    for k, w in enumerate(template):
        places.setdefault(w, []).append(k)
    for p in first:
        for k in places[text[p]]:
            if p >= k and text[p - k : p - k + len(template)] == template:
                return 1.0, p - k, p - k + len(template)

    def attempt(lo: int, hi: int) -> None:
        nonlocal best
        pairs = align(text[lo:hi], template)
        if pairs:
            best = max(best, (len(pairs), lo + pairs[0][0], lo + pairs[-1][0] + 1), key=lambda b: (b[0], -b[1], -b[2]))

    for p in first:
        if p > done:
            attempt(max(0, p - reach), min(len(text), p + reach))
            done = p + reach // 2
    slack = len(template) - least
    # a mark that stands further from the notice's front than from the text's, by more than the slack, is in no match
    if best[0] < least and (spots := [(p, k) for p in first for k in places[text[p]] if p - k + slack >= 0]):
        begins = np.array([p - k for p, k in spots])
        edge = np.zeros(len(text) + 2, np.int64)  # starts within the slack of a mark's place, none after the mark itself
        np.add.at(edge, np.maximum(begins - slack, 0), 1)
        last = np.array([min(p, p - k + slack) for p, k in spots])
        np.add.at(edge, last + 1, -1)
        wanted = np.cumsum(edge[: len(text)]) > 0
        sizes = (len(template), len(template) + slack)
        full = [shared_words(text, template, n) >= least for n in sizes]
        for lo in np.flatnonzero(wanted & (full[0] | full[1])).tolist():
            if best[0] == len(template) and lo > best[1]:
                break
            for size, enough in zip(sizes, full, strict=True):
                if enough[lo]:
                    attempt(lo, min(len(text), lo + size))
    return best[0] / len(template), best[1], best[2]


def _template_codes(templates: dict[str, str]) -> dict[str, list[int]]:
    raw = [t.encode() for t in templates.values()]
    w, codes = word_codes(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])])
    return {k: codes[w.first[i] : w.first[i + 1]].tolist() for i, k in enumerate(templates)}


def _scanner(templates: dict[str, str], coverage: float):
    words = _template_codes(templates)
    counts = Counter(c for t in words.values() for c in set(t))
    # enough words of each template that no match of the asked coverage can miss them all, the rarest first
    marks = {k: set(sorted(set(t), key=lambda c: (counts[c], c))[: len(t) - needed(len(t), coverage) + 1]) for k, t in words.items()}
    distinct = {k: set(t) for k, t in words.items()}
    least = {k: needed(len(t), coverage) for k, t in words.items()}
    every = np.unique(np.array([c for m in marks.values() for c in m], np.uint64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("text")):
                w, codes = word_codes(data, offsets)
                hit = np.flatnonzero(every[np.minimum(np.searchsorted(every, codes), len(every) - 1)] == codes)
                owner, out = w.text_of()[hit], []
                begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]][: len(owner)])
                for s, e in zip(begin, np.r_[begin[1:], len(owner)][: len(begin)], strict=True):
                    row = int(owner[s])
                    text = codes[w.first[row] : w.first[row + 1]].tolist()
                    at = (hit[s:e] - w.first[row]).tolist()
                    present = set(text)
                    for name, t in words.items():
                        if len(distinct[name] - present) > len(t) - least[name]:  # too many of its words are nowhere
                            continue
                        first = [p for p in at if text[p] in marks[name]]
                        if first:
                            share, lo, hi = find(text, t, first, least[name])
                            if share >= least[name] / len(t):
                                out.append((row, name, share, lo, hi))
                rows, names, share, lo, hi = zip(*out, strict=True) if out else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(share, pa.float64()),
                     pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["id", "license", "coverage", "start_word", "end_word"])
    return scan


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """(id, license, coverage, start_word, end_word): templates of which a text holds at least ``coverage``.

    A row per input row and template found, with the best match (ties: see ``find``); words are compared lower-cased
    and without punctuation at their ends.  ``templates`` is a fixed set that goes to every task.  Null and empty texts have no
    matches; null and repeated ids are rows like any other; extra columns are ignored; an empty table gives an empty
    result.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_scanner(templates or TEMPLATES, coverage),
                           f"id {rows.schema['id'].dataType.simpleString()}, license string, coverage double, start_word int, end_word int")
