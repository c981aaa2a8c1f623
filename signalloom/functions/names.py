"""Testcase, template and campaign expressions over file names and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import STANDARD_CAMPAIGN, STANDARD_PREFIX, STANDARD_TEMPLATE
from .text import blank_to_null


def testcase_id(file_name: Column) -> Column:
    """Nine-digit id in a file name; the whole name when there is none."""
    # Accepted positions of the id, in priority order.
    shapes = [r"(?i)(?:trace|result)[_-](\d{9})", r"_(\d{9})_", r"(\d{9})"]
    return F.coalesce(*[blank_to_null(F.regexp_extract(file_name, s, 1)) for s in shapes], file_name)


def template_name(testcase: Column) -> Column:
    return F.when(testcase.startswith(STANDARD_PREFIX), F.lit(STANDARD_TEMPLATE)).otherwise(F.lit("UNKNOWN"))


def campaign_name(testcase: Column, fallback: str = "DEFAULT") -> Column:
    """Campaign by id prefix; ``fallback`` is the site's own campaign label."""
    return F.when(testcase.startswith(STANDARD_PREFIX), F.lit(STANDARD_CAMPAIGN)).otherwise(F.lit(fallback))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
