"""License notices in documents.

Texts and templates are sequences of words (runs of ASCII letters, digits and
other scripts' characters, small letters); their shingles are five words in a row.
A template with fewer words has none, and is refused.

1. Templates are sorted into classes by their number of shingles, up to ``c`` = 1,
   2, 4, 8, ... For each class, windows of 2c shingles overlap by half, so that any
   stretch of c shingles lies within one.
2. A window retrieves a template with which it shares one of ``BANDS`` minwise
   values. If a window holds at least 0.8 of a template, their Jaccard similarity
   is at least 0.8 (c/2) / (2c + 0.2 (c/2)) > 0.19, so the template is retrieved
   with a probability above 1 - 0.81 ** 48 > 0.9999.
   A window can share a value only if it holds the shingle that has it; only
   windows that hold one of those shingles are hashed, which changes no result.
3. A retrieved template matches if at least ``containment`` of its shingles are in
   the window. Matches of a template that overlap become one span. Where spans of
   different templates overlap, one that holds less of its template than another gives way.

A null text is empty; rows without a match have an empty result. Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _io, _text

K, BANDS = 5, 48
_SEEDS = _text.keys(61, BANDS)

#: Wording of public licenses and of the usual references to them.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-notice": "Released under the MIT License.",
    "MIT-reference": "Licensed under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "proprietary": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
}


@dataclass
class Template:
    name: str
    shingles: np.ndarray
    values: np.ndarray
    order: int


def templates(texts: dict[str, str], k: int = K) -> list[Template]:
    out = []
    for name, text in texts.items():
        raw = text.encode()
        w = _text.words(_text.Chunk(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), _text.NOT_ALNUM)
        if len(w.hashes) < k:
            raise ValueError(f"template {name!r} has fewer than {k} words")
        own = np.unique(_text.shingles(w, k)[0])
        out.append(Template(name, own, _text.minhash(own, np.array([0, len(own)]), _SEEDS)[0], 1 << (len(own) - 1).bit_length()))
    return out


def _anchors(known: list[Template]) -> np.ndarray:
    """The shingles that have a template's minwise values."""
    found = [t.shingles[_salted(t.shingles)[:, k] == t.values[k]] for t in known for k in range(BANDS)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _salted(hashes: np.ndarray) -> np.ndarray:
    return (((hashes[:, None] ^ _SEEDS) * (_SEEDS | np.uint64(1))) >> np.uint64(32)).astype(np.uint32)


def matches(chunk: _text.Chunk, known: list[Template], anchors: np.ndarray, containment: float, k: int = K) -> list[tuple[int, str, int, int]]:
    """(row, template, first byte, byte after the last) of all matches, in order."""
    w = _text.words(chunk, _text.NOT_ALNUM)
    hashes, first, ends = _text.shingles(w, k)
    if not len(hashes) or not len(anchors):
        return []
    at = np.searchsorted(anchors, hashes)
    hit = np.flatnonzero(anchors[np.minimum(at, len(anchors) - 1)] == hashes)
    rows = _text.rows_of(ends)[hit]
    spans: dict[tuple[int, str], list[tuple[int, int, float]]] = {}
    for c in sorted({t.order for t in known}):
        own = [t for t in known if t.order == c]
        step = (hit - ends[:-1][rows]) // c
        windows = sorted({(r, s) for r, j in zip(rows.tolist(), step.tolist(), strict=True) for s in (j - 1, j) if s >= 0})
        for r, s in windows:
            a = ends[r] + s * c
            b = min(a + 2 * c, ends[r + 1])
            inside = hashes[a:b]
            values = _salted(inside).min(0)
            for t in own:
                if (values == t.values).any():
                    there = np.isin(inside, t.shingles)
                    share = len(np.unique(inside[there])) / len(t.shingles)
                    if share >= containment:
                        place = np.flatnonzero(there) + a
                        last = min(first[place[-1]] + k, w.ends[r + 1]) - 1
                        spans.setdefault((r, t.name), []).append((int(w.start[first[place[0]]]), int(w.end[last]), share))
    out: list[tuple[int, str, int, int, float]] = []
    for (r, name), found in spans.items():
        merged: list[list] = []
        for a, b, share in sorted(found):
            if merged and a < merged[-1][1]:
                merged[-1][1:] = max(b, merged[-1][1]), max(share, merged[-1][2])
            else:
                merged.append([a, b, share])
        out += [(r, name, *x) for x in merged]
    out.sort(key=lambda x: (x[0], x[2], x[1]))
    near: list[tuple[int, str, int, int, float]] = []  # those before that reach into what follows
    best = dict.fromkeys(out, True)
    for x in out:
        near = [y for y in near if y[0] == x[0] and y[3] > x[2]]
        for y in near:
            if y[4] != x[4]:
                best[min(x, y, key=lambda z: z[4])] = False
        near.append(x)
    return [x[:4] for x in out if best[x]]


_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_matches", T.LongType()), T.StructField("licenses", T.StringType()), T.StructField("spans", T.StringType())])


def scan(docs: DataFrame, texts: dict[str, str] | None = None, containment: float = 0.8) -> DataFrame:
    """doc_id, n_matches, licenses (names, comma-joined), spans (name:start:end, comma-joined) for each row of ``docs`` (doc_id, text)."""
    known = templates(TEMPLATES if texts is None else texts)
    anchors = _anchors(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _text.chunks(batch.column(1)):
                spans: list[list[str]] = [[] for _ in range(chunk.rows)]
                names: list[set[str]] = [set() for _ in range(chunk.rows)]
                points = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])  # code points before each byte
                for r, name, a, b in matches(chunk, known, anchors, containment):
                    start, end = (int(points[x] - points[chunk.ends[r]]) for x in (a, b))
                    spans[r].append(f"{name}:{start}:{end}")
                    names[r].add(name)
                yield _io.to_batch(_SCHEMA, {"doc_id": batch.column(0).slice(chunk.first, chunk.rows), "n_matches": list(map(len, spans)), "licenses": [",".join(sorted(x)) for x in names], "spans": list(map(",".join, spans))})

    return _io.pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, _SCHEMA)
