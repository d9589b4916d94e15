"""Licence notices in whole texts.

Base phrases are places where a phrase's words stand consecutively. The
notices of the templates are found through a positional index of rare words:
each template's words of highest inverse document frequency among the
templates, with their places in it. Every occurrence of such a word in a text
votes for the place where the template would begin; votes that agree, up to a
few inserted or lost words, give a candidate. A candidate counts if all
mandatory key phrases of the template stand in it in their order and enough of
the template's weight is there.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finloom.llm.alnum import AlnumChunk, alnum_chunks

# Phrases of the base and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, notice, mandatory key phrases (separated by |) of common licences.
TEMPLATES = [
    ("mit", "Released under the MIT License.", "mit license"),
    ("mit", "Licensed under the MIT License.", "mit license"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software",
        "free of charge|to deal in the software without restriction|sublicense and or sell",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache license version 2 0"),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at",
        "apache license version 2 0|except in compliance with the license",
    ),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public license version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public license version 3"),
    (
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "redistribute it and or modify it|gnu general public license|version 2 of the license",
    ),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "redistribute it and or modify it|gnu general public license|version 3 of the license",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation",
        "redistribute it and or modify it|gnu lesser general public license",
    ),
    (
        "agpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License",
        "redistribute it and or modify it|gnu affero general public license|version 3",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms|conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
        "for any purpose with or without fee is hereby granted|appear in all copies",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at",
        "mozilla public license v 2 0",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "free and unencumbered software|public domain"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived all copyright|neighboring rights"),
    ("cc-by-4.0", "Licensed under CC BY 4.0.", "cc by 4 0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0.", "cc by nd 4 0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4 0"),
    (
        "cc-by-sa-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "creative commons attribution sharealike 4 0",
    ),
    (
        "cc-by-nc-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "creative commons attribution noncommercial 4 0",
    ),
]

#: Rare words of a template that the index holds (all of a shorter one), the share of them that must agree, words of slack in their places.
RARE = 6
AGREE = 0.5
SLACK = 8
#: Share of a template's weight that a candidate needs.
ENOUGH = 0.75


def words_of(text: str) -> list[bytes]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)]


@dataclass
class Template:
    label: str
    words: list[bytes]
    keys: list[list[bytes]]
    weight: dict[bytes, float]  # by word, its occurrences together; all sum to 1
    rare: dict[bytes, list[int]]  # places of the rarest words
    needed: int


class LicenceIndex:
    """The postings of all templates' rare words, and the words whose places matter at all."""

    def __init__(self, templates=tuple(TEMPLATES), base: dict[str, str] | None = None):
        self.base = [(words_of(p), label) for p, label in (BASE_PHRASES if base is None else base).items()]
        split = [(label, words_of(notice), [words_of(k) for k in keys.split("|")]) for label, notice, keys in templates]
        split = [x for x in split if x[1]]
        holds = Counter(w for _, words, _ in split for w in set(words))
        self.idf = {w: log((1 + len(split)) / n) for w, n in holds.items()}
        self.templates = []
        for label, words, keys in split:
            count = Counter(words)
            total = sum(self.idf[w] * n for w, n in count.items())
            rarest = sorted(count, key=lambda w: (-self.idf[w], words.index(w)))[:RARE]
            rare = {w: [i for i, x in enumerate(words) if x == w] for w in rarest}
            self.templates.append(Template(label, words, keys, {w: self.idf[w] * n / total for w, n in count.items()}, rare, max(1, round(AGREE * len(rarest)))))
        wanted = sorted({w for t in self.templates for w in t.rare} | {w for words, _ in self.base for w in words})
        self.number = {w: i for i, w in enumerate(wanted)}
        self.wanted = wanted
        codes = np.array([zlib.crc32(w) for w in wanted], np.uint32)
        self._order = np.argsort(codes)
        self._codes = codes[self._order]
        if len(np.unique(codes)) < len(codes):
            raise ValueError("two licence words share a checksum")
        # postings of each rare word: template, place in it, whether it counts once per candidate
        rows = [(self.number[w], t, i) for t, template in enumerate(self.templates) for w, places in template.rare.items() for i in places]
        rows = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.postings = rows
        self.first = np.searchsorted(rows[:, 0], np.arange(len(wanted) + 1))

    def numbers(self, chunk: AlnumChunk) -> tuple[np.ndarray, np.ndarray]:
        """Words of the chunk that are in the index: their places and numbers. Equal checksums are compared byte by byte."""
        if not len(self._codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self._codes, chunk.crc), len(self._codes) - 1)
        hit = np.flatnonzero(self._codes[at] == chunk.crc)
        number = self._order[at[hit]]
        sizes = np.array([len(w) for w in self.wanted])
        same = sizes[number] == chunk.size[hit]
        for k in range(int(sizes.max())):
            byte = np.array([w[k] if k < len(w) else 0 for w in self.wanted], np.uint8)
            inside = same & (sizes[number] > k)
            same[inside] = chunk.data[chunk.starts[hit[inside]] + k] == byte[number[inside]]
        return hit[same], number[same]

    def base_places(self, chunk: AlnumChunk, hit: np.ndarray, number: np.ndarray, text: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        """Per base phrase, the indices in ``hit`` where it begins; all its words are in one text and adjacent."""
        for words, label in self.base:
            found = np.flatnonzero(number == self.number[words[0]])
            for k in range(1, len(words)):
                found = found[found + k < len(hit)]
                good = (number[found + k] == self.number[words[k]]) & (hit[found + k] == hit[found] + k) & (text[found + k] == text[found])
                found = found[good]
            yield label, found

    def candidates(self, hit: np.ndarray, number: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Rows (text, template, lowest and highest agreeing begin) where enough different rare words agree on the place of the template."""
        n = self.first[number + 1] - self.first[number]
        source = np.repeat(np.arange(len(hit)), n)
        posting = self.postings[self.first[number[source]] + np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n)]
        begin = hit[source] - posting[:, 2]
        needed = np.array([t.needed for t in self.templates], np.int64)
        found = []
        for offset in (0, SLACK):  # bins of twice the slack that overlap by half
            bins = np.floor_divide(begin + offset, 2 * SLACK)
            rows = np.column_stack([text[source], posting[:, 1], bins, posting[:, 0], begin])
            rows = rows[np.lexsort(rows.T[::-1])]
            if not len(rows):
                continue
            group = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)])
            word = group | np.concatenate([[True], rows[1:, 3] != rows[:-1, 3]])
            first = np.flatnonzero(group)
            different = np.add.reduceat(word.astype(np.int64), first)
            low, high = np.minimum.reduceat(rows[:, 4], first), np.maximum.reduceat(rows[:, 4], first)
            enough = different >= needed[rows[first, 1]]
            found.append(np.column_stack([rows[first, :2], low, high])[enough])
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)

    def accepted(self, template: Template, window: list[bytes]) -> float | None:
        """The share of the template's weight in the window, or None: a key phrase is missing, out of order, or the share too low."""
        place = 0
        for key in template.keys:
            place = next((i + len(key) for i in range(place, len(window) - len(key) + 1) if window[i : i + len(key)] == key), None)
            if place is None:
                return None
        there, count = Counter(window), Counter(template.words)
        share = sum(w * min(1, there[x] / count[x]) for x, w in template.weight.items())
        return min(share, 1.0) if share >= ENOUGH - 1e-9 else None


def scan(chunk: AlnumChunk, index: LicenceIndex) -> list[tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]]:
    """Per text: number of words, base places (word, label) and notices (first word, word behind the last, label, share)."""
    out = [(int(n), [], []) for n in np.diff(chunk.bounds)]
    hit, number = index.numbers(chunk)
    if not len(hit):
        return out
    text = np.searchsorted(chunk.bounds, hit, "right") - 1
    for label, found in index.base_places(chunk, hit, number, text):
        for i in found.tolist():
            out[text[i]][1].append((int(hit[i] - chunk.bounds[text[i]]), label))
    for t, k, low, high in index.candidates(hit, number, text).tolist():
        template = index.templates[k]
        begin = max(low - SLACK, int(chunk.bounds[t]))
        end = min(high + len(template.words) + SLACK, int(chunk.bounds[t + 1]))
        share = index.accepted(template, [chunk.word(i) for i in range(begin, end)])
        if share is not None:
            base = int(chunk.bounds[t])
            out[t][2].append((begin - base, end - base, template.label, share))
    return out


FOUND = """n_words long, base array<struct<word: long, label: string>>,
           notices array<struct<first: long, behind: long, label: string, share: double>>"""


def find_licences(df: DataFrame, text: str = "text", into: str = "licences", index: LicenceIndex | None = None) -> DataFrame:
    """``df`` with ``into``: n_words, base places in order of words, and notices (a window of words, its label, the share of weight).

    Whole texts are scanned; null and empty ones have no words and no places.
    Windows of one notice may repeat with different ends or templates; labels
    are what counts. Repeated rows are scanned each for itself, equal places
    are ordered by label. A column named ``into`` is replaced, other extra
    columns stay. No rows give no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(index or LicenceIndex())
    names = [f.name for f in df.select(F.lit(None).cast(f"struct<{FOUND}>").alias("x")).schema[0].dataType]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        notice_type = pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))
        for texts in batches:
            rows = [r for chunk in alnum_chunks(texts) for r in scan(chunk, own)]
            base = [[{"word": w, "label": x} for w, x in sorted(r[1])] for r in rows]
            notices = [[{"first": a, "behind": b, "label": x, "share": s} for a, b, x, s in sorted(r[2])] for r in rows]
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(base, base_type), pa.array(notices, notice_type)], names)

    return df.withColumn(into, F.arrow_udf(run, FOUND)(F.col(f"`{text}`")))


def summary(found: str = "licences") -> list:
    """n_words, n_base, first_word, last_word, base_labels, labels and score (1 with a base place, else the best share) of the found places."""
    base, notices = F.col(f"{found}.base"), F.col(f"{found}.notices")
    both = F.array_sort(F.array_distinct(F.concat(base.label, notices.label)))
    return [
        F.col(f"{found}.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base.word).alias("first_word"),
        F.array_max(base.word).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base.label)), ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(F.array_max(notices.share), F.lit(0.0))).alias("score"),
    ]
