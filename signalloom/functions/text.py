"""String and clock expressions over single columns, all inside code generation."""

from __future__ import annotations

import re
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import SIGNAL_KEYWORDS

# Characters removed by a bare strip: ASCII blanks, separators, NEL and no-break space.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def strip(col: Column, chars: str = BLANKS) -> Column:
    return F.btrim(col, F.lit(chars))


def quoted(value) -> str:
    """A Python value as a SQL literal."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value}D" if isinstance(value, float) else str(value)


def contains_any(text: str, words) -> str:
    """SQL condition: ``text`` (a SQL expression) holds any of the words."""
    return "(" + " OR ".join(f"contains({text}, {quoted(word)})" for word in words) + ")"


def mentions(col: Column, words) -> Column:
    """Same truth as ``contains_any`` as one pattern, so ``col`` is evaluated once per row."""
    words = list(dict.fromkeys(words))
    needed = [w for w in words if not any(other != w and other in w for other in words)]
    return col.rlike("|".join(re.escape(w) for w in needed))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def pick(key: str, groups: dict, default: str | None = None) -> Column:
    """CASE over ``{result: keys}`` on a SQL expression, built as one SQL text.

    ``default`` is a SQL expression too; without it a key that matches nothing gives null.
    """
    cases = []
    for result, keys in groups.items():
        keys = (keys,) if isinstance(keys, str) else keys
        cases.append(f"WHEN {key} IN ({', '.join(map(quoted, keys))}) THEN {quoted(result)}")
    rest = f" ELSE {default}" if default is not None else ""
    return F.expr(f"CASE {' '.join(cases)}{rest} END")


def after_first(col: Column, mark: str) -> Column:
    """Text behind the first ``mark``."""
    return F.substr(col, F.locate(mark, col) + F.lit(len(mark)))


def assignment_value(line: Column) -> Column:
    """Right-hand side of ``key = 'value';``, unquoted; null without ``=``."""
    rhs = strip(F.substring_index(strip(after_first(line, "=")), ";", 1))
    return F.when(line.contains("="), strip(strip(rhs, "'"), '"'))


def error_value(line: Column) -> Column:
    """Detail of a failure line: behind ``Error``, else behind ``=``, else the line."""
    return (
        F.when(line.contains("Error"), strip(after_first(line, "Error"), " ;:=,\"'"))
        .when(line.contains("="), strip(after_first(line, "="), " ;,\"'"))
        .otherwise(strip(line))
    )


def joined_line(*names: str) -> Column:
    """Columns joined by ``;`` with nulls kept as empty fields."""
    return F.expr("concat_ws(';', " + ", ".join(f"coalesce({n}, '')" for n in names) + ")")


def clock(col: Column) -> Column:
    """``Y-m-d H:M:S.f`` to a zone-free timestamp; null for anything else."""
    text = strip(col)
    shape = r"^\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$"
    return F.when(text.rlike(shape), F.regexp_replace(text, r"\s+", " ").try_cast("timestamp_ntz"))


def clock_text(ts: Column) -> Column:
    """Timestamp as text, with six fraction digits only when there is a fraction."""
    whole = F.date_trunc("second", ts) == ts
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )


def iso_text(ts: Column) -> Column:
    return F.replace(clock_text(ts), F.lit(" "), F.lit("T"))


def epoch_millis(raw: Column) -> Column:
    """First epoch-millisecond number: ``DATETIME(n)``, ``DATETIME = n``, then bare digits."""
    # The three accepted spellings, in priority order.
    shapes = [r"DATETIME\((\d{10,16})\)", r"DATETIME\s*=\s*(\d{10,16})", r"(\d{13,16})"]
    found = [blank_to_null(F.regexp_extract(raw, shape, 1)) for shape in shapes]
    return F.coalesce(*found).try_cast("bigint")


def shifted_clock(millis: Column, shift: Column) -> Column:
    """Epoch milliseconds plus a day-time interval, zone-free; null beyond the year 9999."""
    in_range = millis.between(0, 253402300799999)
    seconds = F.when(in_range, millis).cast("decimal(18,3)") / F.lit(1000)
    origin = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return origin + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")) + shift


def clock_shift(text: Column) -> Column:
    """``+HH:MM`` / ``-HH:MM`` / ``H`` to an interval; parts that are not digits count as 0."""
    value = F.coalesce(blank_to_null(text), F.lit("0"))
    parts = F.split(F.ltrim(value, F.lit("+-")), ":")

    def number(i: int) -> Column:
        part = F.get(parts, F.lit(i))
        return F.coalesce(F.when(part.rlike(r"^\d+$"), part.try_cast("int")), F.lit(0))

    sign = F.when(value.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    return F.make_dt_interval(hours=number(0) * sign, mins=number(1) * sign)


# Time formats by name; any other name gives the ISO form.
CLOCK_FORMATS = {"hour": "HH", "min": "mm", "sec": "ss", "date": "yyyy-MM-dd", "h:m:s": "HH:mm:ss"}


def format_clock(ts: Column, name: str | Column) -> Column:
    """A timestamp in one of the named formats."""
    if isinstance(name, str):
        return F.date_format(ts, CLOCK_FORMATS[name]) if name in CLOCK_FORMATS else iso_text(ts)
    cases = None
    for label, pattern in CLOCK_FORMATS.items():
        shown = F.date_format(ts, pattern)
        cases = F.when(name == label, shown) if cases is None else cases.when(name == label, shown)
    return cases.otherwise(iso_text(ts))


def signal_labels(line: str) -> Column:
    """All signal labels of a line (a column name or SQL expression), in table order."""
    cases = [
        f"CASE WHEN {contains_any(f'lower({line})', words)} THEN {quoted(label)} END"
        for label, words in SIGNAL_KEYWORDS
    ]
    return F.expr(f"array_compact(array({', '.join(cases)}))")


def cut_text(col: Column, limit: int | None, mark: str, trim: bool = False) -> Column:
    """Text cut at ``limit`` characters with ``mark`` appended only when something was cut.

    Without a limit nothing is cut.
    """
    text = F.coalesce(col, F.lit(""))
    text = strip(text) if trim else text
    if limit is None:
        return text
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def shown(col: Column) -> Column:
    """A value as printed text: null as ``None``."""
    return F.coalesce(col.cast("string"), F.lit("None"))


def shown_flag(col: Column) -> Column:
    """A boolean as printed text: ``True`` / ``False`` / ``None``."""
    return F.when(col, F.lit("True")).when(~col, F.lit("False")).otherwise(F.lit("None"))
