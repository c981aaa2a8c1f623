"""Records of large files that are read in byte splits.

A text file is read in splits that begin at a separator byte, wherever that stands: a line break
may lie in a quoted field, a comma in a string or an inner object.  What a split holds depends on
the state in which it begins, so the first pass finds for each split the state it ends in for
either state it may begin in.  A prefix scan over the splits of a file then gives every split its
true beginning, and in the second pass each split yields its whole records and the two pieces
that its neighbours complete.  Rows never leave their task; only one row per split does, and the
pieces of records that lie in several splits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staged

#: Splits whose beginnings are broadcast (some 150 bytes each); with more, they are joined.
MOST_SPLITS = 200_000

_WHOLE, _OPENS, _GOES_ON = 0, 1, 2
_FOUND = "file_path string, at long, place long, kind int, text string"


def _segments(spark: SparkSession, path, separator: str) -> DataFrame:
    """What lies between separators, in file order within a split: value, file_path, start."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("start"))


def _per_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Parts of batches that lie in one split each, with its file and start."""
    for batch in batches:
        start = batch.column("start").to_numpy()
        path = batch.column("file_path")
        edges = [0, *(np.flatnonzero(np.diff(start)) + 1).tolist(), len(start)] if len(start) else [0]
        for a, z in zip(edges, edges[1:]):
            # splits of two files may begin alike, the first ones always do
            while a < z:
                name = path[a].as_py()
                end = z if path[z - 1].as_py() == name else a + int(pc.index(pc.equal(path.slice(a, z - a), name), False).as_py())
                yield (name, int(start[a])), batch.slice(a, end - a)
                a = end


def _with_beginnings(segments: DataFrame, beginnings: DataFrame) -> DataFrame:
    """Segments with the columns of their split, where it has any, still in file order."""
    key = ["file_path", "start"]
    if beginnings.count() <= MOST_SPLITS:
        return segments.join(F.broadcast(beginnings), key, "left")
    rows = segments.withColumn("row", F.monotonically_increasing_id()).join(beginnings, key, "left")
    return rows.repartition(*key).sortWithinPartitions(*key, "row")


def _stitched(segments: DataFrame, beginnings: DataFrame, broken: DataFrame, read: Callable, separator: str) -> DataFrame:
    """file_path, at, place and text of all records; ``broken`` names the files in which records
    lie in several splits."""
    columns = ["file_path", "at", "place", "text"]
    found = _with_beginnings(segments, beginnings).mapInArrow(read, _FOUND)
    files = broken.select("file_path").distinct().withColumn("broken", F.lit(True))
    n_files = files.count()
    if not n_files:
        # what a file leaves open at its end is its last record
        return found.select(*columns)
    few = n_files <= MOST_SPLITS
    theirs = segments.join(F.broadcast(files), "file_path", "left_semi") if few else segments
    pieces = staged(_with_beginnings(theirs, beginnings).mapInArrow(read, _FOUND).where(F.col("kind") != _WHOLE))
    in_turn = Window.partitionBy("file_path").orderBy("at")
    pieces = pieces.join(files, "file_path").withColumn("record", F.sum((F.col("kind") == _OPENS).cast("int")).over(in_turn))
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    joined = pieces.groupBy("file_path", "record").agg(
        F.min("at").alias("at"), F.min_by("place", "at").alias("place"), F.array_join(F.transform(parts, lambda p: p["text"]), separator).alias("text")
    )
    flagged = found.join(F.broadcast(files) if few else files, "file_path", "left")
    whole = flagged.where((F.col("kind") == _WHOLE) | ((F.col("kind") == _OPENS) & F.col("broken").isNull()))
    return whole.select(*columns).unionByName(joined.select(*columns))


class _Found:
    """Rows of ``_FOUND`` of one split."""

    def __init__(self, path: str):
        self.path = path
        self.rows: list[tuple[int, int, int, str]] = []

    def add(self, at: int, place: int, kind: int, text: str) -> None:
        self.rows.append((at, place, kind, text))

    def batch(self) -> pa.RecordBatch:
        at, place, kind, text = zip(*self.rows)
        columns = [pa.array([self.path] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(place, pa.int64()), pa.array(kind, pa.int32()), pa.array(text, pa.string())]
        self.rows = []
        return pa.RecordBatch.from_arrays(columns, names=["file_path", "at", "place", "kind", "text"])


# --- quoted lines ------------------------------------------------------------------------


class QuotedLines:
    """Whether a line leaves a quoted field open, from its text and whether it begins in one.

    Quotes open a field at its first character only and are doubled inside; what follows a
    closing quote belongs to the field, up to the next separator.
    """

    def __init__(self, separator: str):
        sep = re.escape(separator)
        inner = '(?>[^"]++|"")*+'
        field = f'(?:[^"{sep}][^{sep}]*+)?+{sep}|"{inner}"[^{sep}]*+{sep}'
        self.opens = re.compile(f'(?>{field})*+"{inner}\\Z', re.S)
        self.closes = re.compile(f'{inner}"[^{sep}]*+(?:{sep}|\\Z)', re.S)

    def after(self, line: str, inside: bool) -> bool:
        if '"' not in line:
            return inside
        if not inside:
            return self.opens.match(line) is not None
        closed = self.closes.match(line)
        return closed is None or (closed.end() < len(line) and self.opens.match(line, closed.end()) is not None)


def _line_states(lines: QuotedLines):
    """Per split: its first line if it begins the file, and whether it ends in quotes if it began
    outside, or inside."""

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = []
        for key, part in _per_split(batches):
            if not done or done[-1][:2] != [*key]:
                done.append([*key, part.column("value")[0].as_py() if key[1] == 0 else None, False, True])
            now = done[-1]
            value = part.column("value")
            for line in value.filter(pc.match_substring(value, '"')).to_pylist():
                now[3], now[4] = lines.after(line, now[3]), lines.after(line, now[4])
        if done:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
            names = ["file_path", "start", "header", "from_outside", "from_inside"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)

    return states


def _whole_lines(lines: QuotedLines):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, found = None, None
        row = begun = 0
        inside = False
        held: list[str] = []
        kind = _WHOLE

        def leave() -> Iterator[pa.RecordBatch]:
            if held:
                found.add(split[1] + begun, 0, _GOES_ON if kind == _GOES_ON else _OPENS, "\n".join(held))
            if found and found.rows:
                yield found.batch()

        for key, part in _per_split(batches):
            if key != split:
                yield from leave()
                split, found, row, held = key, _Found(key[0]), 0, []
                inside = bool(part.column("inside")[0].as_py())
                kind, begun = (_GOES_ON if inside else _WHOLE), 0
            value = part.column("value")
            for line in value.to_pylist():
                if not held:
                    begun = row
                held.append(line)
                row += 1
                inside = lines.after(line, inside)
                if not inside:
                    text = "\n".join(held)
                    if kind == _WHOLE and text.endswith("\r"):
                        text = text[:-1].replace("\r\n", "\n") if len(held) > 1 else text[:-1]
                    if text or kind == _GOES_ON:
                        found.add(split[1] + begun, 0, kind, text)
                    held, kind = [], _WHOLE
            if found.rows:
                yield found.batch()
        yield from leave()

    return read


def quoted_records(spark: SparkSession, path, separator: str = ";") -> tuple[DataFrame, DataFrame]:
    """Records of separated files with standard quoting, read in parallel: (records, headers).

    ``records``: file_path, at (rises in file order) and text, without the header record; line
    breaks in quotes are ``\\n``, blank records are left out.  ``headers``: file_path, header.
    Lines end in ``\\n`` or ``\\r\\n``, and a header is one line.
    """
    lines = QuotedLines(separator)
    segments = _segments(spark, path, "\n")
    schema = "file_path string, start long, header string, from_outside boolean, from_inside boolean"
    splits = staged(segments.mapInArrow(_line_states(lines), schema))
    # a split either keeps the state, turns it, or sets it; since the last that sets it, count turns
    ahead = Window.partitionBy("file_path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("from_outside") == F.col("from_inside")
    last_set = F.last(F.when(sets, F.struct("start", "from_outside")), True).over(ahead)
    turns = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    turned = F.sum(turns).over(ahead)
    scanned = splits.withColumns({"set": last_set, "turned": F.coalesce(turned, F.lit(0)), "sets": sets, "turns": turns})
    # turns up to and with the split that set it
    upto = Window.partitionBy("file_path").orderBy("start")
    scanned = scanned.withColumn("upto", F.sum("turns").over(upto))
    at_set = F.last(F.when(F.col("sets"), F.col("upto")), True).over(ahead)
    inside = (F.coalesce(F.col("set.from_outside"), F.lit(False)).cast("int") + F.col("turned") - F.coalesce(at_set, F.lit(0))) % 2 == 1
    begins = staged(scanned.select("file_path", "start", inside.alias("inside")).where("inside"))
    found = _stitched(segments, begins, begins, _whole_lines(lines), "\n")
    # a record that lies in several splits may hold the line ends of its file
    crlf = F.col("text").rlike("\r$")
    text = F.when(crlf, F.regexp_replace(F.regexp_replace("text", "\r$", ""), "\r\n", "\n")).otherwise(F.col("text"))
    records = found.where("at > 0 AND text != ''").select("file_path", "at", text.alias("text"))
    headers = splits.where("start = 0").select("file_path", F.regexp_replace("header", "[\r\ufeff\"]", "").alias("header"))
    return records, headers


# --- arrays ------------------------------------------------------------------------------


class _Depths:
    """Strings and brackets of the segments between commas, counted from the split's beginning.

    ``odd``: whether a segment ends after an odd number of quotes.  ``depth[s]``: how far the
    brackets up to its end lead in or out, if the split began outside (0) or inside (1) a string.
    """

    def __init__(self, value: pa.Array, quotes: int = 0, depth: tuple[int, int] = (0, 0)):
        raw = pc.cast(value, pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
        ends = offsets[1:] - offsets[0]
        quote = data == 34
        slash = data == 92
        if slash.any():
            at = np.arange(len(data))
            other = np.maximum.accumulate(np.where(slash, -1, at))
            run = np.zeros(len(data), np.int64)
            run[1:] = at[:-1] - other[:-1]
            quote &= run % 2 == 0
        where = np.flatnonzero(quote | (data == 91) | (data == 93) | (data == 123) | (data == 125))
        mark = data[where]
        is_quote = mark == 34
        odd = (np.cumsum(is_quote) + quotes) % 2
        step = np.where(is_quote, 0, np.where((mark == 91) | (mark == 123), 1, -1))
        upto = np.searchsorted(where, ends)

        def at_ends(counts: np.ndarray, before: int) -> np.ndarray:
            return np.concatenate([[before], counts])[upto]

        self.odd = at_ends(odd, quotes % 2)
        self.depth = [at_ends(np.cumsum(np.where(odd == s, step, 0)) + depth[s], depth[s]) for s in (0, 1)]


_SPLIT_DEPTHS = (
    "file_path string, start long, odd int, in_0 long, in_1 long, commas_0 map<long,long>, commas_1 map<long,long>, "
    "opens boolean, named boolean"
)


def _array_states(names: tuple[str, ...]):
    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        for key, part in _per_split(batches):
            value = part.column("value")
            if not done or (done[-1]["file_path"], done[-1]["start"]) != key:
                done.append({"file_path": key[0], "start": key[1], "odd": 0, "in_0": 0, "in_1": 0, "commas_0": {}, "commas_1": {}, "opens": None, "named": False})
            now = done[-1]
            if now["opens"] is None:
                first = next((v.lstrip(" \t\r\n\ufeff") for v in value.to_pylist() if v.strip(" \t\r\n\ufeff")), "")
                now["opens"] = first.startswith("[") if first else None
            now["named"] = now["named"] or any(pc.any(pc.match_substring(value, f'"{n}"')).as_py() for n in names)
            depths = _Depths(value, now["odd"], (now["in_0"], now["in_1"]))
            for s in (0, 1):
                counts = now[f"commas_{s}"]
                for depth, n in zip(*np.unique(depths.depth[s][depths.odd == s], return_counts=True)):
                    counts[int(depth)] = counts.get(int(depth), 0) + int(n)
            now["odd"], now["in_0"], now["in_1"] = int(depths.odd[-1]), int(depths.depth[0][-1]), int(depths.depth[1][-1])
        if done:
            kind = pa.map_(pa.int64(), pa.int64())
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), kind, kind, pa.bool_(), pa.bool_()]
            columns = [[d[c] if not c.startswith("commas") else list(d[c].items()) for d in done] for c in done[0]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=list(done[0]))

    return states


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, found = None, None
    row = begun = place = depth = base = odd = 0
    held: list[str] = []
    kind = _WHOLE

    def text_of(values: list[str], ended: bool) -> str:
        text = ",".join(values)
        if base and kind != _GOES_ON and split[1] + begun == 0:
            text = text.lstrip(" \t\r\n\ufeff")[1:]
        if base and ended:
            text = text.rstrip(" \t\r\n")
            if not text.endswith("]"):
                raise ValueError(f"more than one array in {split[0]}")
            text = text[:-1]
        return text

    def leave() -> Iterator[pa.RecordBatch]:
        if held:
            ended = not odd and depth == 0
            text = text_of(held, ended)
            found.add(split[1] + begun, place, _GOES_ON if kind == _GOES_ON else _WHOLE if ended else _OPENS, text)
        if found and found.rows:
            yield found.batch()

    for key, part in _per_split(batches):
        if key != split:
            yield from leave()
            split, found, row, held = key, _Found(key[0]), 0, []
            given = {c: part.column(c)[0].as_py() for c in ("odd", "depth", "place", "base")}
            base = 1 if given["base"] is None else given["base"]
            odd, depth, place = (given[c] or 0 for c in ("odd", "depth", "place"))
            kind, begun = (_GOES_ON if key[1] and (odd or depth != base) else _WHOLE), 0
        depths = _Depths(part.column("value"), odd, (depth, depth))
        odd_ends, depth_ends = depths.odd, depths.depth[0]
        values = part.column("value").to_pylist()
        last = 0
        for i in np.flatnonzero((odd_ends == 0) & (depth_ends == base)).tolist():
            if not held:
                begun = row + last
            found.add(split[1] + begun, place, kind, text_of([*held, *values[last : i + 1]], False))
            held, kind, last = [], _WHOLE, i + 1
            place += 1
        if last < len(values):
            if not held:
                begun = row + last
            held.extend(values[last:])
        row += len(values)
        odd, depth = int(odd_ends[-1]), int(depth_ends[-1])
        if found.rows:
            yield found.batch()
    yield from leave()


def array_elements(spark: SparkSession, path, names: tuple[str, ...] = ()) -> DataFrame:
    """The elements of JSON arrays in files of any size: file_path, place (from 0) and text.

    A file holds one array, or one object, which is its only element.  With ``names``, files
    none of whose text has one of these names in quotes are skipped.  Files in folders
    ``part=0``, ``part=1`` .. of one folder are one array, in that order.
    """
    segments = _segments(spark, path, ",")
    splits = staged(segments.mapInArrow(_array_states(names), _SPLIT_DEPTHS))
    ahead = Window.partitionBy("file_path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file_path")
    scan = splits.withColumn("s", F.coalesce(F.sum("odd").over(ahead), F.lit(0)) % 2)
    inner = F.when(F.col("s") == 1, F.col("in_1")).otherwise(F.col("in_0"))
    scan = scan.withColumns(
        {
            "depth": F.coalesce(F.sum(inner).over(ahead), F.lit(0)),
            "base": F.coalesce(F.first("opens", True).over(whole.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(False)).cast("int"),
            "wanted": F.max("named").over(whole) if names else F.lit(True),
        }
    )
    commas = F.when(F.col("s") == 1, F.col("commas_1")).otherwise(F.col("commas_0"))
    scan = scan.withColumn("n", F.coalesce(F.try_element_at(commas, F.col("base") - F.col("depth")), F.lit(0)))
    part = F.regexp_extract("file_path", r"/part=(\d+)/[^/]*$", 1)
    folder = F.when(part == "", F.col("file_path")).otherwise(F.regexp_replace("file_path", r"/part=\d+/[^/]*$", ""))
    files = scan.groupBy("file_path").agg((F.sum("n") + 1).alias("held"))
    before = Window.partitionBy(folder).orderBy(F.when(part == "", F.lit("0")).otherwise(part).cast("long"), "file_path")
    files = files.select("file_path", (F.sum("held").over(before) - F.col("held")).alias("earlier"))
    scan = staged(
        scan.join(files, "file_path").select(
            "file_path", "start", F.col("s").cast("int").alias("odd"), "depth", "base", "wanted",
            (F.col("earlier") + F.coalesce(F.sum("n").over(ahead), F.lit(0))).alias("place"),
        )
    )
    begins = scan.where("start > 0 OR base = 0 OR place > 0").drop("wanted")
    skipped = scan.where("NOT wanted").select("file_path").distinct()
    if names and not skipped.isEmpty():
        segments = segments.join(F.broadcast(skipped) if skipped.count() <= MOST_SPLITS else skipped, "file_path", "left_anti")
        begins = begins.join(skipped, "file_path", "left_anti")
    broken = begins.where("start > 0 AND (odd = 1 OR depth != base)")
    found = _stitched(segments, begins, broken, _elements, ",")
    return found.where(F.trim("text") != "").select("file_path", "place", "text")
