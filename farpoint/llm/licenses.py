"""License scan: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates' word k-grams stand in an inverted index. A text's k-grams are winnowed: of every
``WINDOW`` consecutive ones the least hash is kept, so any common run of K + WINDOW - 1 words
shares a fingerprint. Each hit proposes (template, diagonal); a banded alignment around the diagonal
gives the matched words, coverage of the template, and the span in the text.

Cases: null and blank texts match nothing; repeated rows are scanned each; null ids stay null; an
empty table gives an empty table; texts are scanned whole. Of overlapping matches the one with more
matched words stays, ties to the earlier template by name.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from farpoint.llm.common import flat_words, pick, ship, slices, texts_of, tidy

K, WINDOW, BAND = 3, 3, 6
COVERAGE = 0.8
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Short notices of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at"
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation"
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files, to deal in the Software without restriction"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def normal(words: pa.Array) -> pa.Array:
    """Lower case, without signs at either end."""
    return pc.replace_substring_regex(pc.utf8_lower(words), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def words_of(text: str) -> list[str]:
    return normal(pa.array(WORD.findall(text), type=pa.string())).to_pylist()


def align(template: list[int], text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, start, end) of the template against text words near start ``diagonal``.

    Whole template, any part of the text: +1 a match, -1 a mismatch or gap, cells within ``band``
    of the diagonal only.
    """
    m = len(template)
    lo = max(0, diagonal - band)
    hi = min(len(text), diagonal + m + band)
    low = -(10**6)
    row = {j: (0, 0, j) for j in range(lo, hi + 1) if abs(j - diagonal) <= band}
    for i in range(1, m + 1):
        cur: dict[int, tuple[int, int, int]] = {}
        for j in range(max(lo, diagonal + i - band), min(hi, diagonal + i + band) + 1):
            best = (low, 0, 0)
            if j - 1 in row:
                s, hits, st = row[j - 1]
                same = bool(text[j - 1] == template[i - 1])
                best = max(best, (s + (1 if same else -1), hits + same, st))
            if j in row:
                s, hits, st = row[j]
                best = max(best, (s - 1, hits, st))
            if j - 1 in cur:
                s, hits, st = cur[j - 1]
                best = max(best, (s - 1, hits, st))
            if best[0] > low:
                cur[j] = best
        row = cur
    if not row:
        return 0, 0, 0
    s, j = max((v[0], -j) for j, v in row.items())
    _, hits, start = row[-j]
    return hits, start, -j


class LicenseIndex:
    def __init__(self, templates: dict[str, str] | None = None):
        self.names = sorted(templates or TEMPLATES)
        texts = [words_of((templates or TEMPLATES)[n]) for n in self.names]
        self.vocabulary = sorted({w for t in texts for w in t if w})
        code = {w: i + 1 for i, w in enumerate(self.vocabulary)}
        self.values = pa.array(self.vocabulary, type=pa.string())
        self.templates = [[code.get(w, -1) for w in t] for t in texts]
        self.grams: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, seq in enumerate(self.templates):
            for p, g in enumerate(self.hashes(np.array(seq, dtype=np.int64)).tolist()):
                self.grams[g].append((t, p))
        self.known = np.array(sorted(self.grams), dtype=np.uint64)

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """Hash of each K-gram; the greatest value where a word is in no template."""
        n = len(codes) - K + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        out, bad = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
        for j in range(K):
            c = codes[j : j + n]
            bad |= c <= 0
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        out ^= out >> np.uint64(29)
        out[bad] = np.uint64((1 << 64) - 1)
        return out

    def fingerprints(self, h: np.ndarray) -> np.ndarray:
        """Winnowed positions: the least hash of every WINDOW consecutive ones (the last of equals)."""
        if len(h) <= WINDOW:
            return np.arange(len(h))
        view = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
        return np.unique(np.arange(len(view)) + WINDOW - 1 - view[:, ::-1].argmin(axis=1))

    def matches(self, codes: np.ndarray, coverage: float) -> list[tuple[int, int, int, float]]:
        """(template, start word, end word, coverage), without overlaps, by start."""
        h = self.hashes(codes)
        anchors: dict[tuple[int, int], set[int]] = defaultdict(set)
        for p in self.fingerprints(h).tolist():
            for t, q in self.grams.get(int(h[p]), ()):
                anchors[(t, (p - q) // BAND)].add(p - q)
        found = []
        for (t, _), diagonals in anchors.items():
            d = sorted(diagonals)[len(diagonals) // 2]
            hits, start, end = align(self.templates[t], codes, d)
            share = hits / len(self.templates[t])
            if share >= coverage and end > start:
                found.append((-hits, t, start, end, share))
        out: list[tuple[int, int, int, float]] = []
        for _, t, s, e, share in sorted(found):
            if not any(s < b and a < e for _, a, b, _ in out):
                out.append((t, s, e, share))
        return sorted(out, key=lambda x: x[1])

    def scan(self, texts: pa.Array, coverage: float = COVERAGE) -> dict[int, list[tuple[str, int, int, float]]]:
        """(name, start, end, coverage) in code points, for the texts that have any."""
        index, words, offsets = flat_words(pc.ascii_split_whitespace(texts))
        if not len(index):
            return {}
        code = pc.fill_null(pc.index_in(normal(words), self.values), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        codes = code[index]
        run = codes > 0
        three = run[:-2] & run[1:-1] & run[2:] if len(run) > 2 else np.zeros(0, dtype=bool)
        rows = np.unique(np.searchsorted(offsets, np.flatnonzero(three), side="right") - 1)
        out = {}
        for i in rows.tolist():
            seq = codes[offsets[i] : offsets[i + 1]]
            text = texts[i].as_py()
            lead = 1 if WORD.match(text) is None else 0  # an empty word before leading white space
            found = self.matches(seq[lead:], coverage)
            if found:
                at = [m.span() for m in WORD.finditer(text)]
                out[i] = [(self.names[t], at[s][0], at[e - 1][1], share) for t, s, e, share in found]
        return out


def find_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, found array<struct<license, start, end, coverage>>) for every row."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    span = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LicenseIndex(templates)
        for batch in batches:
            for part in slices(batch):
                got = index.scan(texts_of(part), coverage)
                rows = [[dict(zip(("license", "start", "end", "coverage"), x, strict=True)) for x in got.get(i, [])] for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, type=pa.list_(span))], names=["doc_id", "found"])

    return pick(df, doc_id=id_col, text=text_col).mapInArrow(tidy(run), f"doc_id {kind}, found array<struct<license:string,start:bigint,end:bigint,coverage:double>>")
