"""Groups of rows out of sorted Arrow-fed pandas batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd


def sorted_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Column arrays of each run of equal keys; a run may span batches.

    Rows must arrive sorted by the keys.  Only one group is held at a time, and cutting
    plain arrays costs far less per group than a pandas call for each.
    """

    def joined(pieces):
        if len(pieces) == 1:
            return pieces[0]
        return {name: np.concatenate([p[name] for p in pieces]) for name in pieces[0]}

    open_pieces: list[dict[str, np.ndarray]] = []
    for pdf in batches:
        if not len(pdf):
            continue
        columns = {name: pdf[name].to_numpy() for name in pdf.columns}
        changes = np.zeros(len(pdf), dtype=bool)
        for key in keys:
            changes[1:] |= columns[key][1:] != columns[key][:-1]
            if open_pieces:
                changes[0] |= columns[key][0] != open_pieces[-1][key][-1]
        marks = np.flatnonzero(changes)
        if open_pieces and len(marks) and marks[0] == 0:
            yield joined(open_pieces)
            open_pieces, marks = [], marks[1:]
        start = 0
        for mark in marks:
            open_pieces.append({name: values[start:mark] for name, values in columns.items()})
            yield joined(open_pieces)
            open_pieces, start = [], mark
        open_pieces.append({name: values[start:] for name, values in columns.items()})
    if open_pieces:
        yield joined(open_pieces)
