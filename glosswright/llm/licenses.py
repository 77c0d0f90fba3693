"""License scan: MinHash bands over overlapping text windows retrieve templates, containment verifies.

A template of n shingles meets windows of n shingles that begin every n / 4 shingles, so some window
shares at least 7/8 of a whole copy; with 24 bands of 2 rows such a pair (Jaccard 0.77 or more) meets in a
band with probability above 1 - 1e-9, and one at the verified containment of 0.8 still above 0.999.
Windows without any shingle of a template have similarity 0 and are not hashed.  Retrieved templates are
verified around the window with their exact shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_bytes
from .shingles import blocks, mix, shingle_hashes, word_hashes

K, BANDS, ROWS = 5, 24, 2

#: Notices that licenses ask to be carried, as published.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys (len(sets), BANDS) of shingle sets."""
    lengths = np.array([len(s) for s in sets])
    flat, start = np.concatenate(sets), np.cumsum(lengths) - lengths
    mins = np.stack([np.minimum.reduceat(mix(flat ^ s), start) for s in SEEDS], 1).reshape(len(sets), BANDS, ROWS)
    with np.errstate(over="ignore"):
        return mix(mins[:, :, 0] * np.uint64(3) + mins[:, :, 1] + np.arange(BANDS, dtype=np.uint64))


class Templates:
    def __init__(self, templates: dict[str, list[str]]):
        self.names = [k for k, v in templates.items() for _ in v]
        words, counts = word_hashes([t.encode() for v in templates.values() for t in v])
        flat, n = shingle_hashes(words, counts, K)
        self.sets = [np.unique(x) for x in np.split(flat, np.cumsum(n)[:-1])]
        self.spans = n
        self.known = np.unique(flat)
        self.bands: list[dict[int, list[int]]] = [{} for _ in range(BANDS)]
        for t, keys in enumerate(signature(self.sets).tolist()):
            for band, key in zip(self.bands, keys, strict=True):
                band.setdefault(key, []).append(t)
        self.widths = sorted(set(n.tolist()))

    def scan(self, shingles: np.ndarray, containment: float):
        """[(template, first shingle, share of the template found)], at most one of each license and place."""
        at = np.searchsorted(self.known, shingles)
        hits = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] == shingles)
        if not len(hits):
            return []
        found: dict[tuple[int, int], tuple[float, int]] = {}
        for width in self.widths:
            step = max(1, width // 4)
            begins = np.unique(np.maximum(0, ((hits[:, None] - np.arange(0, width + step, step)) // step) * step).ravel())
            begins = begins[begins < len(shingles)]
            keys = signature([shingles[b : b + width] for b in begins]).tolist()
            for b, row in zip(begins.tolist(), keys, strict=True):
                for t in {t for band, key in zip(self.bands, row, strict=True) for t in band.get(key, ())}:
                    if self.spans[t] != width:
                        continue
                    low = max(0, b - width)
                    near = shingles[low : b + 2 * width]
                    held = np.flatnonzero(np.isin(near, self.sets[t]))
                    # the best stretch of the template's own length around the window
                    best, where = 0, 0
                    for i in held.tolist():
                        n = len(np.intersect1d(near[i : i + width], self.sets[t]))
                        if n > best:
                            best, where = n, i
                    share = best / len(self.sets[t])
                    if share >= containment:
                        key = (t, low + where)
                        found[key] = max(found.get(key, (0.0, 0)), (share, width))
        return [(t, at, share) for (t, at), (share, _) in sorted(found.items())]


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, containment: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, license, n_matches, first_shingle, containment): a row for each document and license found.

    Narrow tasks without a shuffle.  Null and empty texts give no row; repeated rows each give their own;
    a text of under five words is one shingle.
    """

    def run(batches):
        known = Templates(templates)
        for batch in batches:
            docs_, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows, i = [], 0
            for block in blocks(texts):
                flat, n = shingle_hashes(*word_hashes(block), K)
                place = np.minimum(np.searchsorted(known.known, flat), len(known.known) - 1)
                end = np.cumsum(n)
                texts_hit = np.unique(np.searchsorted(end, np.flatnonzero(known.known[place] == flat), side="right"))
                for j in texts_hit.tolist():
                    by: dict[str, list] = {}
                    for t, at, share in known.scan(flat[end[j] - n[j] : end[j]], containment):
                        by.setdefault(known.names[t], []).append((at, share))
                    rows += [(docs_[i + j], name, len({a for a, _ in m}), min(m)[0], round(max(s for _, s in m), 6)) for name, m in sorted(by.items())]
                i += len(block)
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "license", "n_matches", "first_shingle", "containment"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text")).mapInArrow(run, "doc_id long, license string, n_matches long, first_shingle long, containment double")
