"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

A template of n words belongs to the tier L, the least power of two >= n (8 at
least).  Texts are read in windows of 2L words that start every L words, so
every occurrence of a template lies in one window of its tier.  A window that
holds n of a template's m shingles, just enough for ``containment``, shares at
least J = n / (2L + m - n) with it, for the m of the tier at which that is
least (m is L/2 - 3 or more); one minimum under each of b random orders is one band, and
b = ceil(ln(1 - p) / ln(1 - J)) bands meet with probability p (``recall``).  A
retrieved template counts if at least ``containment`` of its shingles are in
the window (all of them compared).

Words: A-Z lower-cased, then runs of digits, letters and non-ASCII characters;
shingles of five words, or one of all words where a template has fewer.
Defined results: a null or empty text has no license; a template without words
never matches; of several windows with the same template the best is returned,
on a tie the first; repeated rows give repeated results; other columns are
kept, except one with the name of the output.  Templates are a parameter
(a few hundred at most travel with the task); texts are never cut.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from visiflow.llm.common import Grams, text_chunks, word_hashes, word_spans

SHINGLE = 5
_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else 0x20 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)], np.uint8)
_GAP = np.arange(256) == 0x20

# FIXED VALUES: wording of public license notices.
TEMPLATES = {
    "Apache-2.0 (statement)": "Licensed under the Apache License, Version 2.0.",
    "MIT (statement)": "Released under the MIT License.",
    "GPL-3.0 (statement)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (statement)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (statement)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                           "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
                           "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                           "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT (permission)": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
                        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
                        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL (notice)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD (conditions)": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                        "following disclaimer.",
    "ISC (permission)": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
                        "provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0 (notice)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
                 "or distribute this software",
}


def bands_for(tier: int, recall: float, containment: float, fewest: int | None = None) -> int:
    """Bands for every match that the exact check accepts; ``fewest`` different shingles of a template, if below those of its words."""
    least = max(1, tier // 2 - 3)
    shingles = range(least if fewest is None else min(least, fewest), max(2, tier - 3))
    needed = [max(1, math.ceil(containment * m - 1e-9)) for m in shingles]
    share = min(n / (2 * tier + m - n) for m, n in zip(shingles, needed))
    return math.ceil(math.log(1 - recall) / math.log(1 - share))


class Text:
    """Words of a run of texts, and the hashes of the shingles that start at each."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        buf = _FOLD[buf]
        starts, ends, self.first = word_spans(buf, off, _GAP)
        self.n = np.diff(self.first)
        self.grams = Grams(word_hashes(buf, starts, ends))
        count = np.maximum(self.n - SHINGLE + 1, 0)
        self.cut = np.concatenate([[0], np.cumsum(count)])  # of each text's shingles
        at = np.arange(self.cut[-1]) + np.repeat(self.first[:-1] - self.cut[:-1], count)
        self.shingles = self.grams.at(at, SHINGLE)


class Matcher:
    """Bands and shingle sets of the templates, by tier."""

    def __init__(self, templates: dict[str, str], containment: float, recall: float):
        self.names, self.containment, self.tiers = list(templates), containment, {}
        self.sets, self.short = [], {}
        rng = np.random.default_rng(31)
        for k, text in enumerate(templates.values()):
            data = np.frombuffer(text.encode(), np.uint8)
            t = Text(data, np.array([0, len(data)]))
            self.sets.append(np.unique(t.shingles))
            if len(t.shingles):
                tier = max(8, 1 << (int(t.n[0]) - 1).bit_length())
                self.tiers.setdefault(tier, []).append(k)
            elif t.n[0]:  # fewer words than a shingle: one shingle of all of them
                self.short.setdefault(int(t.n[0]), []).append((k, t.grams.at(np.array([0]), int(t.n[0]))[0]))
        self.orders = {tier: rng.integers(0, 1 << 63, (bands_for(tier, recall, containment, min(len(self.sets[k]) for k in some)), 2), dtype=np.uint64)
                       * np.uint64(2) + np.uint64(1) for tier, some in self.tiers.items()}

    def find(self, t: Text) -> list[dict[int, tuple[float, int, int]]]:
        """Per text: template -> (containment, first word of the window, its end)."""
        out: list[dict] = [{} for _ in t.n]
        for words, some in self.short.items():
            at = np.flatnonzero(np.arange(t.grams.n) + words <= t.first[1:][np.repeat(np.arange(len(t.n)), t.n)])
            hashes = t.grams.at(at, words)
            for k, h in some:
                for x in at[hashes == h][::-1].tolist():
                    d = int(np.searchsorted(t.first, x, "right")) - 1
                    out[d][k] = (1.0, x - int(t.first[d]), x - int(t.first[d]) + words)
        for tier, members in self.tiers.items():
            count = np.diff(t.cut)
            blocks = -(-count // tier)
            text = np.repeat(np.arange(len(count)), blocks)
            if not len(text):
                continue
            number = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            start = t.cut[:-1][text] + number * tier
            paired = np.flatnonzero(number + 1 < blocks[text])
            hits = set()
            for x, m in self.orders[tier]:
                low = np.minimum.reduceat((t.shingles ^ x) * m, start)
                low[paired] = np.minimum(low[paired], low[paired + 1])  # the right side is read whole before it is written
                for k in members:
                    hits.update((w, k) for w in np.flatnonzero(low == ((self.sets[k] ^ x) * m).min()).tolist())
            for w, k in sorted(hits):
                d = int(text[w])
                a, b = int(start[w]), min(int(start[w]) + 2 * tier, int(t.cut[d + 1]))
                share = float(np.isin(self.sets[k], t.shingles[a:b]).mean())
                if share >= self.containment and share > out[d].get(k, (0.0,))[0]:
                    first = a - int(t.cut[d])
                    out[d][k] = (share, first, min(first + 2 * tier, int(t.n[d])))
        return out


LICENSES = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("containment", T.DoubleType()),
                                     T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, recall: float = 0.999,
                  text_col: str = "text", out: str = "licenses") -> DataFrame:
    """Add ``out``: the templates in each text, by name, with containment and the word window that holds them."""
    templates = TEMPLATES if templates is None else templates
    kept = [f for f in df.schema.fields if f.name.lower() != out.lower()]
    names = [f.name for f in kept]
    kind = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        matcher = Matcher(templates, containment, recall)
        for batch in batches:
            for row, buf, off in text_chunks(batch.column(text_col)):
                found = matcher.find(Text(buf, off))
                lists = pa.array([sorted(({"license": matcher.names[k], "containment": c, "start": a, "end": b} for k, (c, a, b) in x.items()),
                                         key=lambda m: m["license"]) for x in found], kind)
                part = batch.slice(row, len(off) - 1)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), lists], names=[*names, out])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, LICENSES)]))
