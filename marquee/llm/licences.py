"""Licence scan: a trained paragraph classifier.

Paragraphs are runs of lines with words; a line without (blank, or of signs, as
in comments) ends one. Candidates are every line, so that a notice amid other
lines is found, and for wrapped notices the stretches of lines of one paragraph
that hold a share of CONFIRM or more of some notice's word pairs, with the
shortest for each such share and the whole paragraph among them. Their features
are hashed words and word pairs, across line ends too (ASCII letters in lower
case, signs as blanks), over the root of their number. A multinomial logistic regression tells the licence families from each
other and from ``unknown``. It is trained on variants of the families' own
notices (words dropped, doubled or put around them, halves) and, for unknown,
on lines of the corpus that no notice resembles or is wrapped in: at most SAMPLE_DOCS documents
of at most SAMPLE_BYTES, in the order of a hash of the id. A fourth of the
rows is held back to calibrate: the temperature that makes their probabilities
most likely, unknown among them. (To hold back whole notices instead doubles the
temperature; wrapped notices of the GPL then stay below LEAST beside the AGPL's
and LGPL's, which share most of their words.)

A candidate counts for a family when its calibrated probability is LEAST at
least and beats the others, and one of the family's notices confirms it: a
share of CONFIRM of the notice's word pairs stands in it. Of candidates that
overlap, the one with the larger share stays (then the shorter). Null and
empty texts have no paragraph with words; null ids are scanned like others."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import kernels as K
from marquee.llm.shared import columns, sample

FEATURES, LEAST, CONFIRM = 1 << 15, 0.5, 0.6
SAMPLE_DOCS, SAMPLE_BYTES, VARIANTS, EPOCHS = 150, 4 << 20, 30, 120
UNKNOWN = "unknown"
#: Short notices by which works name their licence.
NOTICES: dict[str, list[str]] = {
    "AGPL": ["This program is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License.", "Released under the AGPL version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0", "Published under the Apache License 2.0.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "Licensed under the BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "SPDX-License-Identifier: BSD-2-Clause"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under the CC BY 4.0 licence.", "Licensed under Creative Commons BY 3.0."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Available under the CC BY-NC 4.0 licence."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Available under the CC BY-SA 4.0 licence.", "Licensed under Creative Commons BY-SA 3.0."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 into the public domain.", "Dedicated to the public domain under CC0 1.0."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.", "SPDX-License-Identifier: BSL-1.0"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Released under the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.", "Released under the GPL version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "Released under the LGPL version 3.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "SPDX-License-Identifier: MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Released under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
    "proprietary": ["All rights reserved. No part of this work may be reproduced without written permission.", "Copyright. All rights reserved.", "Confidential and proprietary. Do not distribute."],
}
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


@dataclass
class Model:
    families: list[str]  # unknown comes last
    weights: np.ndarray  # FEATURES x families, float32
    bias: np.ndarray
    temperature: float
    pairs: list[list[np.ndarray]]  # each family's notices as sorted hashes of word pairs


def featured(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line of each text: word hashes with the lines' offsets, the
    lines' texts, and the hashes of the pairs of each word with the next of its
    line (0 for the last)."""
    data, offs = K.raw(texts)
    breaks = np.flatnonzero(data == 0x0A) + 1
    lines = np.unique(np.concatenate([offs, breaks]))
    lines = lines if len(lines) > 1 else np.array([0, len(data)])
    folded = _FOLD[data]
    starts, ends, rows = K.word_bounds(folded, lines)
    w = K.word_hashes(folded, starts, ends)
    doc = np.searchsorted(offs, lines[:-1], "right") - 1
    pair = np.zeros(len(w), np.uint64)
    if len(w) > 1:
        pair[:-1] = K.mix(w[:-1] * np.uint64(K.WORDS_BASE) + w[1:])
        last = rows[1:][np.diff(rows) > 0] - 1
        pair[last] = 0
    return w, rows, doc, pair


def joined(w: np.ndarray, lines: np.ndarray, doc: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with those of each line's last word and the first of the next
    line of its paragraph, and each line's paragraph."""
    full = np.diff(lines) > 0
    on = full[:-1] & full[1:] & (doc[:-1] == doc[1:])
    last = lines[1:-1][on] - 1
    whole = pair.copy()
    whole[last] = K.mix(w[last] * np.uint64(K.WORDS_BASE) + w[last + 1])
    return whole, np.concatenate([[0], np.cumsum(~on)])


def shortest(kinds: list[int], level: int) -> Iterator[tuple[int, int]]:
    """The stretches of ``kinds`` (first, last) with ``level`` distinct ones of
    which no part has as many."""
    n: Counter[int] = Counter()
    left = 0
    for right, x in enumerate(kinds):
        n[x] += 1
        while len(n) > level or n[kinds[left]] > 1:
            n[kinds[left]] -= 1
            if not n[kinds[left]]:
                del n[kinds[left]]
            left += 1
        if len(n) == level and n[x] == 1:
            yield left, right


def stretches(pairs: list[list[np.ndarray]], whole: np.ndarray, lines: np.ndarray, paragraph: np.ndarray) -> dict[tuple[int, int], set[int]]:
    """Stretches of two lines or more (first, last) of one paragraph with a share
    of CONFIRM or more of a notice's pairs, and the lines where those stand."""
    notices = [n for f in pairs for n in f if len(n)]
    known = np.unique(np.concatenate(notices))
    quick = np.zeros(1 << 16, bool)
    quick[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(quick[(whole & np.uint64(0xFFFF)).astype(np.int64)])
    at = at[np.isin(whole[at], known)]
    first = np.searchsorted(lines, at, "right") - 1
    many = np.bincount(paragraph)[paragraph[first]] > 1
    at, first = at[many], first[many]
    if not len(at):
        return {}
    last = first + (at == lines[first + 1] - 1)  # a pair across the line's end
    kind = np.searchsorted(known, whole[at])
    held = np.stack([np.isin(known, n) for n in notices], 1)
    groups, group = np.unique(paragraph[first], return_inverse=True)
    once = np.unique(group * len(known) + kind)
    n = np.add.reduceat(held[once % len(known)].astype(np.int32), np.searchsorted(once // len(known), np.arange(len(groups))), axis=0)
    size = held.sum(0)
    out: dict[tuple[int, int], set[int]] = {}
    for g, c in zip(*np.nonzero(n / size >= CONFIRM), strict=True):
        a, b = np.searchsorted(group, [g, g + 1])
        own = a + np.flatnonzero(held[kind[a:b], c])
        kinds, starts, ends = kind[own].tolist(), first[own].tolist(), last[own].tolist()
        found = [(0, len(own) - 1, *(np.searchsorted(paragraph, [groups[g], groups[g] + 1]) - [0, 1]).tolist())]
        for level in range(int(np.ceil(CONFIRM * size[c] - 1e-9)), n[g, c] + 1):
            found += [(i, j, starts[i], max(ends[i : j + 1])) for i, j in shortest(kinds, level)]
        for i, j, x, y in found:
            if x < y:
                out.setdefault((x, y), set()).update(starts[i : j + 1], ends[i : j + 1])
    return out


def logits(weights: np.ndarray, bias: np.ndarray, w: np.ndarray, rows: np.ndarray, pair: np.ndarray) -> np.ndarray:
    mask = np.uint64(FEATURES - 1)
    each = weights[(w & mask).astype(np.int64)] + np.where(pair != 0, 1, 0).astype(np.float32)[:, None] * weights[(pair & mask).astype(np.int64)]
    n = np.diff(rows)
    out = np.zeros((len(n), weights.shape[1]), np.float32)
    full = np.flatnonzero(n)
    if len(full):
        out[full] = np.add.reduceat(each, rows[full], axis=0) / np.sqrt(2 * n[full] - 1)[:, None]
    return out + bias


def stretch_logits(weights: np.ndarray, bias: np.ndarray, w: np.ndarray, lines: np.ndarray, whole: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """As logits, of stretches of lines of one paragraph: of sums over lines, so
    that many long stretches cost no more."""
    x, y = min(s[0] for s in spans), max(s[1] for s in spans) + 1
    a, b = lines[x], lines[y]
    mask = np.uint64(FEATURES - 1)
    ends = lines[x + 1 : y + 1] - 1
    inner = whole[a:b] != 0
    inner[ends - a] = False
    each = weights[(w[a:b] & mask).astype(np.int64)] + inner.astype(np.float32)[:, None] * weights[(whole[a:b] & mask).astype(np.int64)]
    zero = np.zeros((1, weights.shape[1]))
    own = np.concatenate([zero, np.cumsum(np.add.reduceat(each, lines[x:y] - a, axis=0), axis=0, dtype=np.float64)])
    over = np.concatenate([zero, np.cumsum(weights[(whole[ends] & mask).astype(np.int64)], axis=0, dtype=np.float64)])
    i, j = np.array(spans).T - x
    n = lines[j + x + 1] - lines[i + x]
    return ((own[j + 1] - own[i] + over[j] - over[i]) / np.sqrt(2 * n - 1)[:, None] + bias).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def similarity(notices: list[np.ndarray], pairs: np.ndarray) -> float:
    """The largest share of a notice's word pairs that the paragraph has."""
    return max(float(np.isin(n, pairs).mean()) if len(n) else 0.0 for n in notices)


def notice_pairs() -> list[list[np.ndarray]]:
    """Each family's notices as sorted hashes of word pairs."""
    out = []
    for f in sorted(NOTICES):
        _, rows, _, p = featured(pa.array(NOTICES[f]))
        out.append([np.unique(p[a:b][p[a:b] != 0]) for a, b in zip(rows[:-1], rows[1:], strict=True)])
    return out


def train(lines: list[str], seed: int = 5) -> Model:
    """lines: of the corpus; those that resemble a notice are left out."""
    families = [*sorted(NOTICES), UNKNOWN]
    pairs = notice_pairs()
    kept = []
    if lines:
        _, rows, _, p = featured(pa.array(lines))
        kept = [t for t, a, b in zip(lines, rows[:-1], rows[1:], strict=True) if b > a and max(similarity(n, p[a:b]) for n in pairs) < 0.3]
    rng = np.random.default_rng(seed)
    around = [x for t in kept[:200] for x in t.split()] or ["the", "of", "and", "work", "text", "page"]
    texts, code = list(kept), [len(families) - 1] * len(kept)
    for c, f in enumerate(families[:-1]):
        for notice in NOTICES[f]:
            for v in range(VARIANTS):
                words = notice.split()
                if v:
                    words = [x for x in words if rng.random() > 0.08] or words
                    if v % 4 == 1:
                        words = [*rng.choice(around, rng.integers(1, 6)).tolist(), *words]
                    if v % 4 == 2:
                        words = [*words, *rng.choice(around, rng.integers(1, 6)).tolist()]
                texts.append(" ".join(words))
                code.append(c)
    # plain words of licences in other places are unknown
    for _ in range(200):
        words = [x for f in NOTICES.values() for t in f for x in t.split()]
        texts.append(" ".join([*rng.choice(around, 12).tolist(), *rng.choice(words, 3).tolist()]))
        code.append(len(families) - 1)
    w, rows, _, pair = featured(pa.array([t.replace("\n", " ") for t in texts]))
    code_ = np.array(code)
    held = np.arange(len(code_)) % 4 == 3
    weights, bias = fit(w, rows, pair, code_, ~held, len(families))
    z = logits(weights, bias, w, rows, pair)[held]
    loss = {t: -np.log(softmax(z / t)[np.arange(held.sum()), code_[held]] + 1e-12).mean() for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)}
    return Model(families, weights, bias, min(loss, key=loss.get), pairs)


def fit(w: np.ndarray, rows: np.ndarray, pair: np.ndarray, code: np.ndarray, learn: np.ndarray, families: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of the regression on the rows that ``learn`` marks."""
    n = np.diff(rows)
    row = np.repeat(np.arange(len(n)), n)
    mask = np.uint64(FEATURES - 1)
    ids = np.concatenate([(w & mask).astype(np.int64), (pair[pair != 0] & mask).astype(np.int64)])
    of = np.concatenate([row, row[pair != 0]])
    scale = (1 / np.sqrt(np.maximum(2 * n - 1, 1))).astype(np.float32)
    order = np.argsort(ids, kind="stable")
    used, first = np.unique(ids[order], return_index=True)
    of = of[order]
    weights, bias = np.zeros((FEATURES, families), np.float32), np.zeros(families, np.float32)
    target = np.eye(families, dtype=np.float32)[code]
    share = np.bincount(code[learn], minlength=families)
    each = np.where(learn, 1 / np.maximum(share[code], 1), 0).astype(np.float32)
    each[code == families - 1] *= 3
    each /= each.sum()
    g2, b2 = np.full((len(used), families), 1e-8, np.float32), np.full(families, 1e-8, np.float32)
    for _ in range(EPOCHS):
        wrong = (softmax(logits(weights, bias, w, rows, pair)) - target) * each[:, None]
        grad = np.add.reduceat((wrong * scale[:, None])[of], first, axis=0) + 1e-6 * weights[used]
        g2 += grad * grad
        b2 += wrong.sum(0) ** 2
        weights[used] -= 0.5 * grad / np.sqrt(g2)
        bias -= 0.5 * wrong.sum(0) / np.sqrt(b2)
    return weights, bias


def sample_lines(docs: DataFrame, id_col: str, text_col: str) -> list[str]:
    """Lines of the sample, without those that a wrapped notice stands in."""
    rows = columns(docs, id=id_col, text=text_col).where("id is not null and text is not null").where(F.octet_length("text") <= SAMPLE_BYTES // 64)
    total, out = 0, []
    pairs = notice_pairs()
    for r in sample(rows, "id", SAMPLE_DOCS).collect():  # SAMPLE_DOCS rows
        size = len(r["text"].encode())
        if total + size > SAMPLE_BYTES:
            continue
        total += size
        w, lines, doc, pair = featured(pa.array([r["text"]]))
        whole, paragraph = joined(w, lines, doc, pair)
        wrapped = set().union(*stretches(pairs, whole, lines, paragraph).values())
        out += [x for i, x in enumerate(r["text"].split("\n")) if x.strip() and i not in wrapped]
    return out


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``n_paragraphs`` (lines with words),
    ``licence`` (the confirmed family of highest probability, or null),
    ``probability``, ``similarity``, ``n_confirmed``, ``families`` (all that
    are confirmed, sorted, joined by commas) and ``found`` (each confirmed
    candidate's first line, family, probability, similarity and number of lines)."""
    model = model or train(sample_lines(docs, id_col, text_col))
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = columns(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    found_type = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("lines", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        m = held.value
        for batch in batches:
            for a, b in K.pieces(batch.column("text"), 1 << 19):
                w, lines, doc, pair = featured(batch.column("text").slice(a, b - a))
                n = np.zeros(b - a, np.int64)
                found: list[list[dict]] = [[] for _ in range(b - a)]
                if len(w):
                    np.add.at(n, doc, np.diff(lines) > 0)
                    p = softmax(logits(m.weights, m.bias, w, lines, pair) / m.temperature)
                    best = p.argmax(1)
                    turn = np.arange(len(doc)) - np.searchsorted(doc, doc)
                    sure: list[tuple[float, float, int, int, int]] = []  # similarity, probability, family, first and last line
                    for i in np.flatnonzero((best < len(m.families) - 1) & (p.max(1) >= LEAST) & (np.diff(lines) > 0)):
                        s = similarity(m.pairs[best[i]], pair[lines[i] : lines[i + 1]])
                        sure.append((s, float(p[i, best[i]]), int(best[i]), int(i), int(i)))
                    whole, paragraph = joined(w, lines, doc, pair)
                    spans = sorted(stretches(m.pairs, whole, lines, paragraph))
                    for _, some in groupby(spans, lambda x: paragraph[x[0]]):
                        own = list(some)
                        for (x, y), q in zip(own, softmax(stretch_logits(m.weights, m.bias, w, lines, whole, own) / m.temperature), strict=True):
                            c = int(q.argmax())
                            if c < len(m.families) - 1 and q[c] >= LEAST:
                                sure.append((similarity(m.pairs[c], whole[lines[x] : lines[y + 1] - 1]), float(q[c]), c, x, y))
                    taken = np.zeros(len(doc), bool)
                    for s, q, c, x, y in sorted(sure, key=lambda v: (-v[0], v[4] - v[3], -v[1], v[3])):
                        if s >= CONFIRM and not taken[x : y + 1].any():
                            taken[x : y + 1] = True
                            found[doc[x]].append({"line": int(turn[x]), "family": m.families[c], "probability": q, "similarity": s, "lines": y - x + 1})
                    for f in found:
                        f.sort(key=lambda v: v["line"])
                top = [max(f, key=lambda x: (x["probability"], x["similarity"], x["family"])) if f else None for f in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(n), pa.array([t and t["family"] for t in top], pa.string()), pa.array([t and t["probability"] for t in top], pa.float64()), pa.array([t and t["similarity"] for t in top], pa.float64()), pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(sorted({x["family"] for x in f})) for f in found], pa.string()), pa.array(found, found_type)],
                    names=["id", "n_paragraphs", "licence", "probability", "similarity", "n_confirmed", "families", "found"],
                )

    out = rows.mapInArrow(run, f"id {kind}, n_paragraphs long, licence string, probability double, similarity double, n_confirmed long, families string, found array<struct<line:int,family:string,probability:double,similarity:double,lines:int>>")
    return out.withColumnRenamed("id", id_col)
