"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

A template of n word shingles is looked for in windows of 2 W shingles that begin every W, W
being the power of two from n up; every run of n shingles lies whole in one of them.  A window
that holds the wanted share of a template has a Jaccard similarity above a known bound, and the
number of bands follows from that bound and the wanted chance to meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import WHOLE_TEXTS
from .packed import LOWER, PUNCT, mix, span_digests, utf8, words

# Public license statements that documents carry.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:",
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "All rights reserved": "All rights reserved.",
} | WHOLE_TEXTS


def bands_for(similarity: float, chance: float) -> int:
    """Bands of one row that let two sets of this similarity meet with this chance."""
    return math.ceil(math.log(1 - chance) / math.log(1 - similarity))


def _shingles(digests: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digest of the shingle that begins at each word, and whether it lies in one text."""
    n = max(0, len(digests) - size + 1)
    out = mix(digests[:n] + np.uint64(size))
    for j in range(1, size):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + digests[j : n + j])
    return out, text[:n] == text[size - 1 : n + size - 1]


#: Shingles hashed at a time, so that the passes stay in the processor's cache.
_AT_ONCE = 1 << 15


def _upper(digests: np.ndarray) -> np.ndarray:
    return (digests >> np.uint64(32)).astype(np.uint32)


class Scanner:
    """The templates' shingles and MinHash values, by shingle size and window size."""

    def __init__(self, templates: dict[str, str], shingle: int, containment: float, chance: float):
        self.containment, self.groups = containment, {}
        for name in sorted(templates):
            buf, offsets = utf8(pa.array([templates[name]]))
            low = LOWER[buf]
            starts, ends, text = words(low, offsets, PUNCT)
            size = min(shingle, len(starts))
            if size:
                own = np.unique(_shingles(span_digests(low, starts, ends), text, size)[0])
                wide = 1 << (len(own) - 1).bit_length()
                self.groups.setdefault((size, wide), []).append((name, own))
        self.bands = {}
        for (size, wide), members in self.groups.items():
            least = min(len(own) for _, own in members)
            shared = containment * least
            bands = bands_for(shared / (2 * wide + least - shared), chance)
            rng = np.random.default_rng([size, wide])
            factors = rng.integers(0, 2**31, bands, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
            self.bands[size, wide] = [(f, np.array([self._hash(_upper(own), f).min() for _, own in members])) for f in factors]

    @staticmethod
    def _hash(values: np.ndarray, factor: np.uint32) -> np.ndarray:
        """A permutation of 32-bit values, which are the upper halves of mixed digests."""
        return values * factor

    def scan(self, texts) -> list[tuple[int, str, float, int, int]]:
        """(text, template, containment, first word, places) of each text and template found in it."""
        buf, offsets = utf8(texts)
        low = LOWER[buf]
        starts, ends, text = words(low, offsets, PUNCT)
        digests = span_digests(low, starts, ends)
        first_word = np.searchsorted(starts, offsets[:-1])
        best: dict[tuple[int, str], dict[int, float]] = {}
        for (size, wide), members in self.groups.items():
            values, inside = _shingles(digests, text, size)
            if not len(values):
                continue
            for window, which in self._candidates(values, size, wide):
                name, own = members[which]
                a, z = window * wide, min(len(values), (window + 2) * wide)
                at = np.flatnonzero(np.isin(values[a:z], own) & inside[a:z]) + a
                for t in np.unique(text[at]):
                    here = at[text[at] == t]
                    share = len(np.unique(values[here])) / len(own)
                    if share >= self.containment:
                        places = best.setdefault((int(t), name), {})
                        place = int(here[0] - first_word[t])
                        places[place] = max(share, places.get(place, 0.0))
        out = []
        for (t, name), places in sorted(best.items()):
            top = max(places.values())
            out.append((t, name, top, min(p for p, s in places.items() if s == top), len(places)))
        return out

    def _candidates(self, values: np.ndarray, size: int, wide: int) -> list[tuple[int, int]]:
        """(window, member) pairs that meet in a band; windows are hashed some thousands at a time."""
        rows = -(-len(values) // wide)
        padded = np.zeros((rows + 1) * wide, np.uint32)
        padded[: len(values)] = _upper(values)
        padded[len(values) :] = padded[max(0, len(values) - 1)]  # no shingles of its own past the end
        grid = padded.reshape(rows + 1, wide)
        found = set()
        step = max(1, _AT_ONCE // wide)
        for at in range(0, rows, step):
            part = grid[at : at + step + 1]
            for factor, wanted in self.bands[size, wide]:
                hashed = self._hash(part, factor)
                least = hashed.min(axis=1) if wide > 1 else hashed[:, 0]
                least = np.minimum(least[:-1], least[1:])
                for m, value in enumerate(wanted):
                    met = least == value
                    if met.any():
                        found |= {(at + int(w), m) for w in np.flatnonzero(met)}
        return sorted(found)


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    shingle: int = 5,
    containment: float = 0.8,
    chance: float = 0.999,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document and template in it: doc_id, license, containment, first_word, n_places.

    ``containment`` is the share of the template's distinct shingles in one window, ``first_word``
    where the best place begins, ``n_places`` the number of places.  Words are runs of letters
    and digits, A-Z lower-cased; a template of fewer words than a shingle is one shingle.  Null
    and empty texts hold no template.  Templates are a small list that goes to every task.
    """
    known = dict(TEMPLATES if templates is None else templates)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, shingle, containment, chance)
        for batch in batches:
            rows = scanner.scan(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.float64()),
                    pa.array([r[3] for r in rows], pa.int64()),
                    pa.array([r[4] for r in rows], pa.int64()),
                ],
                names=["doc_id", "license", "containment", "first_word", "n_places"],
            )

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(found, f"doc_id {id_type}, license string, containment double, first_word long, n_places long")
