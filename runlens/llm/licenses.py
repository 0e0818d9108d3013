"""Licence scan: passages compared with licence templates by the Dice coefficient of their word bigrams.

Texts and templates are normalised to lower-case words of letters and digits. For each template, the document's bigrams that the
template has are found; hits at most `MAX_GAP` words apart form a chain. Within a chain every stretch from one hit to another is
a passage if its number of distinct bigrams is within the bounds that the threshold allows for the template's number; it gets its
exact Dice coefficient. Stretches whose first bigram recurs in them are left out, as they are no better without it; so a chain costs
at most its hits times the template's bigrams. Whole texts are scanned, so notices inside longer lines are found too.

Defined cases: null and empty texts have no finding; a text with several passages of a licence gets one row with the best
(the first of equals) and their number (of those that share words, the best counts); a passage that reaches the threshold for several templates gets a row for each
licence; an empty table gives an empty result; repeated rows give repeated findings; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runlens.llm import common
from runlens.llm.toxicity import lookup

THRESHOLD = 0.8
MAX_GAP = 4

#: Short notices and permission paragraphs by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("all-rights-reserved", "All rights reserved."),
]


def bigrams(data: np.ndarray, offs: np.ndarray):
    """(bigram hashes, first word of each, starts, ends, text of each word)."""
    low = common.lower(data)
    starts, ends, doc = common.words(low, offs, common.WORD)
    at, h = common.windows(common.Hashes(low).of(starts, ends), doc, 2)
    return h, at, starts, ends, doc


def prepared(templates: list[tuple[str, str]]) -> list[tuple[str, np.ndarray]]:
    out = []
    for name, text in templates:
        for _, data, offs in common.chunks(iter([pa.RecordBatch.from_pydict({"text": [text]})])):
            out.append((name, np.unique(bigrams(data, offs)[0])))
    return [(n, b) for n, b in out if len(b)]


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Set sizes that can reach the Dice threshold against a set of n."""
    return int(np.ceil(n * threshold / (2 - threshold) - 1e-9)), int(np.floor(n * (2 - threshold) / threshold + 1e-9))


def passages(h: np.ndarray, mine: np.ndarray, n_own: int, threshold: float) -> list[tuple[float, int, int]]:
    """(dice, first bigram, last bigram) of the best passage from each hit of a chain that reaches the threshold, in order.

    `h` holds the bigrams of the text, `mine` the places of the chain's hits."""
    lo, hi = size_bounds(n_own, threshold)
    keys = h[mine].tolist()
    if len(set(keys)) < lo:
        return []
    base = int(mine[0])
    grams, places = h[base : int(mine[-1]) + 1].tolist(), (mine - base).tolist()
    again, seen_at = [0] * len(keys), {}
    for i in range(len(keys) - 1, -1, -1):
        again[i] = seen_at.get(keys[i], len(keys))
        seen_at[keys[i]] = i
    out = []
    for i in range(len(keys)):
        found: set[int] = set()
        done, matched, best = places[i], 0, (0.0, 0)
        for k in range(i, again[i]):
            found.update(grams[done : places[k]])
            done = places[k]
            new = keys[k] not in found
            found.add(keys[k])
            if len(found) > hi:
                break
            matched += new
            if new and matched >= lo:
                dice = 2 * matched / (len(found) + n_own)
                if dice >= threshold and dice > best[0]:
                    best = (dice, places[k])
        if best[0]:
            out.append((best[0], base + places[i], base + best[1]))
    return out


def apart(found: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Of passages that share words, the best (the first of equals); they come best first."""
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for dice, a, b in sorted(found, key=lambda x: (-x[0], x[1])):
        i = bisect_left(starts, a)
        # a passage ends with the second word of its last bigram
        if (i == 0 or ends[i - 1] + 1 < a) and (i == len(starts) or b + 1 < starts[i]):
            starts.insert(i, a)
            ends.insert(i, b)
            out.append((dice, a, b))
    return out


def _scan_task(templates: list[tuple[str, np.ndarray]], threshold: float, max_gap: int):
    every = np.unique(np.concatenate([b for _, b in templates]))
    members = [np.isin(every, b) for _, b in templates]
    bounds = [size_bounds(len(b), threshold) for _, b in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in common.chunks(batches):
            h, at, starts, ends, doc = bigrams(data, offs)
            place = lookup(every, h)
            hits = np.flatnonzero(place >= 0)
            found: dict[tuple[int, str], list[tuple[float, int, int]]] = {}
            for t, (name, own) in enumerate(templates):
                mine = hits[members[t][place[hits]]]
                if not len(mine):
                    continue
                # a bigram's number within its text grows by one a word, so gaps are differences of `at`
                cut = np.flatnonzero((np.diff(at[mine]) > max_gap) | (np.diff(doc[at[mine]]) != 0)) + 1
                edges = [0, *cut.tolist(), len(mine)]
                for x, y in zip(edges, edges[1:], strict=False):
                    # fewer hits than the least set cannot reach the threshold
                    if y - x < bounds[t][0]:
                        continue
                    for dice, a, b in passages(h, mine[x:y], len(own), threshold):
                        found.setdefault((int(doc[at[a]]), name), []).append((dice, int(at[a]), int(at[b])))
            best: dict[tuple[int, str], list] = {}
            for key, some in found.items():
                some = apart(some)
                best[key] = [some[0][0], some[0][1], some[0][2] + 1, len(some)]
            keys = sorted(best)
            d = np.array([k[0] for k in keys], np.int64)
            a, b = np.array([best[k][1] for k in keys], np.int64), np.array([best[k][2] for k in keys], np.int64)
            cols = [rows.column("doc_id").take(pa.array(d)), pa.array([k[1] for k in keys], pa.string()), pa.array([best[k][0] for k in keys], pa.float64()), pa.array([best[k][3] for k in keys], pa.int64())]
            spans = [common.char_positions(data, offs, starts[a], d), common.char_positions(data, offs, ends[b], d)] if keys else [d, d]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spans[0]), pa.array(spans[1])], names=["doc_id", "license", "dice", "n_passages", "start", "end"])

    return run


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, max_gap: int = MAX_GAP) -> DataFrame:
    """One row per document and licence found: doc_id, license, dice, n_passages, start, end (of the best passage, code points)."""
    return common.bound_batches(docs).select("doc_id", "text").mapInArrow(_scan_task(prepared(templates), threshold, max_gap), "doc_id long, license string, dice double, n_passages long, start long, end long")
