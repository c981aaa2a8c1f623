"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every word sequence of the normalised test items.  Training words stream
through it while the length of the longest match is tracked; a match as long as a window
marks its words.  Marked spans are cut out, and a document that is mostly marked goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .blocks import shielded, with_text
from .packed import PUNCT

#: Lower-cases A-Z and turns every byte that is in no word into a space.
_TABLE = bytes(32 if PUNCT[b + 32 if 65 <= b <= 90 else b] else (b + 32 if 65 <= b <= 90 else b) for b in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return (text if isinstance(text, bytes) else text.encode()).translate(_TABLE).split()


class Automaton:
    """All word sequences of the items, and which items hold each window.

    States are the classes of word sequences that end at the same places; ``length`` is the
    longest sequence of a state, ``link`` the state of its longest suffix outside the class.
    """

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int = 10):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.length, self.link, self.step = [0], [-1], [{}]
        texts: list[tuple[str | None, list[int]]] = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if ids:
                texts.append((item, ids))
                last = 0
                for word in ids:
                    last = self._extend(last, word)
        #: state -> {window length: items}, and the least number of words that can be hit
        self.ends: dict[int, dict[int, set[str]]] = {}
        self.shortest = min((min(window, len(ids)) for _, ids in texts), default=0)
        self.window_lengths = sorted({min(window, len(ids)) for _, ids in texts})
        for item, ids in texts:
            size = min(window, len(ids))
            for end, (state, matched) in enumerate(self.walk(ids)):
                if end + 1 >= size:
                    found = self.ends.setdefault(self._class(state, size), {}).setdefault(size, set())
                    if item is not None:
                        found.add(item)

    def _extend(self, last: int, word: int) -> int:
        length, link, step = self.length, self.link, self.step
        if word in step[last]:
            known = step[last][word]
            if length[known] == length[last] + 1:
                return known
            return self._split(last, word, known)
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        at = last
        while at != -1 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at != -1:
            known = step[at][word]
            link[new] = known if length[known] == length[at] + 1 else self._split(at, word, known)
        return new

    def _split(self, at: int, word: int, known: int) -> int:
        """A state of its own for the shorter sequences of ``known``."""
        copy = len(self.length)
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[known])
        self.step.append(dict(self.step[known]))
        self.link[known] = copy
        while at != -1 and self.step[at].get(word) == known:
            self.step[at][word] = copy
            at = self.link[at]
        return copy

    def walk(self, ids: Iterable[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word (-1: in no item)."""
        state = matched = 0
        for word in ids:
            while state and word not in self.step[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.step[state]:
                state = self.step[state][word]
                matched += 1
            else:
                matched = 0
            yield state, matched

    def _class(self, state: int, size: int) -> int:
        """The state that holds the last ``size`` words of a match."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words stand inside an occurrence of a window, and the items of those windows."""
        hit = np.zeros(len(words), dtype=bool)
        items: set[str] = set()
        if not self.shortest or len(words) < self.shortest:
            return hit, items
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        known = np.concatenate([[0], (ids >= 0).view(np.int8), [0]])
        edges = np.flatnonzero(np.diff(known))
        # a match never leaves a run of known words, and runs that are too short hold no window
        for start, end in edges.reshape(-1, 2)[np.diff(edges)[::2] >= self.shortest]:
            for at, (state, matched) in enumerate(self.walk(ids[start:end].tolist()), start + 1):
                for size in self.window_lengths:
                    if size > matched:
                        break
                    held = self.ends.get(self._class(state, size), {}).get(size)
                    if held is not None:
                        hit[at - size : at] = True
                        items |= held
        return hit, items


def _shards(items: DataFrame, item: str, text: str, max_words: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in lists of at most ``max_words`` words; the driver holds one list at a time."""
    shard, size = [], 0
    rows = items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).distinct()
    for row in rows.toLocalIterator(prefetchPartitions=False):
        n = len(words_of(row["text"]))
        if n:
            if size and size + n > max_words:
                yield shard
                shard, size = [], 0
            shard.append((row["item"], row["text"]))
            size += n
    yield shard


_MARKS = "n_words long, spans array<long>, items array<string>, clean string"
FOUND = "__leak_marks"


def mark(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    item: str = "item_id",
    item_text: str = "text",
    text: str = "text",
    max_words: int = 500_000,
    cut: bool = False,
) -> DataFrame:
    """All columns of ``docs`` and ``__leak_marks`` (struct: n_words, spans, items, clean).

    ``spans`` holds first word and one past the last word of each maximal marked run, in turn;
    ``items`` the sorted ids of the items whose windows occur.  An item of fewer words than a
    window is a window of its own; one without words is none; one without an id marks words
    and is not listed.  A null text has no words.  No items: no marks.
    With ``cut`` a marked text is also given without its spans, in ``clean``.

    What is broadcast is bounded by ``max_words`` (an automaton takes some 800 bytes a word): a
    larger test set is cut into shards of items, which the driver reads one after another.  The
    documents are written with their marks between two shards, so that one is held at a time.
    """
    shards = _shards(items, item, item_text, max_words)
    context = docs.sparkSession.sparkContext
    shard, n, held = next(shards), 0, None
    while shard is not None:
        following = next(shards, None)
        if held is not None:
            docs = staged(docs)
            held.unpersist()
        shared = held = context.broadcast(shard)
        last = following is None

        def marked(batches: Iterator[tuple[pa.Array, pa.Array]], shared=shared, cut=cut and last) -> Iterator[pa.Array]:
            automaton = Automaton(shared.value, window)
            for texts, before in batches:
                rows = []
                for value, old in zip(texts.cast(pa.large_binary()), before):
                    data = value.as_py()
                    words = words_of(data)
                    hit, found = automaton.hits(words)
                    if old.is_valid:
                        for a, b in zip(*[iter(old["spans"].as_py())] * 2):
                            hit[a:b] = True
                        found |= set(old["items"].as_py())
                    runs = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                    clean = _without(data, runs.tolist(), automaton) if cut and len(runs) else None
                    rows.append((len(words), runs.tolist(), sorted(found), clean))
                yield pa.StructArray.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                        pa.array([r[2] for r in rows], pa.list_(pa.string())),
                        pa.array([r[3] for r in rows], pa.string()),
                    ],
                    names=["n_words", "spans", "items", "clean"],
                )

        before = F.col(FOUND) if n else F.lit(None).cast(f"struct<{_MARKS.replace(' ', ':').replace(',:', ',')}>")
        docs = docs.withColumn(FOUND, F.arrow_udf(marked, _MARKS, F.ArrowUDFType.SCALAR_ITER)(F.col(text), before))
        shard, n = following, n + 1
    return docs


def report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """Per document: its words, its marked words, and the items found in it."""
    marked = mark(docs, items, **how)
    spans = F.col(f"{FOUND}.spans")
    # lengths of the runs: ends are at odd places, starts at even ones
    n_hit = F.aggregate(
        F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return marked.select(
        F.col(doc_id).alias("doc_id"),
        F.col(f"{FOUND}.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(f"{FOUND}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{FOUND}.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(spans) > 0).alias("contaminated"),
    )


def _without(data: bytes, spans: list[int], automaton: Automaton) -> str:
    """The text without its spans, and without what its parts hold once they have met."""
    while spans:
        data = cut_words(data, spans)
        hit, _ = automaton.hits(words_of(data))
        spans = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist()
    return data.decode()


def cut_words(data: bytes, spans: list[int]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    plain = data.translate(_TABLE)
    solid = np.concatenate([[0], (np.frombuffer(plain, np.uint8) != 32).view(np.int8), [0]])
    edges = np.flatnonzero(np.diff(solid))
    kept, at = [], 0
    for first, last in zip(spans[::2], spans[1::2]):
        kept.append(data[at : edges[2 * first]])
        at = int(edges[2 * last - 1])
    kept.append(data[at:])
    return b"".join(kept)


def remove(docs: DataFrame, items: DataFrame, max_coverage: float = 0.5, text: str = "text", **how) -> DataFrame:
    """The documents with their own columns, without what they share with the test items.

    Marked spans leave the text; a document more than ``max_coverage`` of whose words are
    marked leaves the table.  All other documents stay as they are.
    """
    plain, own = shielded(docs, text, "n_chars")
    # one Python step marks and cuts
    marked = mark(plain, items, text=text, cut=True, **how)
    spans = F.col(f"{FOUND}.spans")
    covered = F.aggregate(
        F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x
    )

    kept = marked.where(covered <= F.col(f"{FOUND}.n_words") * max_coverage)
    return own(with_text(kept, F.coalesce(F.col(f"{FOUND}.clean"), F.col(text)), text))
