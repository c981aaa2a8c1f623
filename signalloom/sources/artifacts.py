"""Discovery of trace, result, report and template files per testcase."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names


def list_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """File listing: ``path``, ``file_name``, ``length``.  Contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{suffix}")
        .load(folder)
        .select("path", names.base_name(F.col("path")).alias("file_name"), "length")
    )


def by_testcase(files: DataFrame, column: str) -> DataFrame:
    """One path per testcase; of several the highest."""
    return files.groupBy(names.testcase_id(F.col("file_name")).alias("testcase_id")).agg(
        F.max("path").alias(column)
    )


def match_artifacts(
    traces: DataFrame,
    results: DataFrame,
    reports: DataFrame,
    templates: DataFrame | None = None,
    fallback_campaign: str = "DEFAULT",
    group: str = "default",
) -> DataFrame:
    """One row per testcase that has a trace, with its result, report and the template.

    Inputs are listings (``path``, ``file_name``).
    """
    joined = (
        by_testcase(traces, "trace_path")
        .join(by_testcase(results, "result_path"), "testcase_id", "left")
        .join(by_testcase(reports, "report_path"), "testcase_id", "left")
    )
    template = F.lit(None).cast("string") if templates is None else templates.agg(F.min("path")).scalar()
    testcase = F.col("testcase_id")
    return joined.select(
        "testcase_id",
        "trace_path",
        "result_path",
        "report_path",
        template.alias("template_path"),
        names.template_name(testcase).alias("template_name"),
        names.campaign_name(testcase, fallback_campaign).alias("campaign_name"),
        F.lit("operational_trace").alias("report_type"),
        F.lit(group).alias("group"),
        F.lit("0").alias("time_change"),
    )


def discover(
    spark: SparkSession,
    trace_dir: str,
    result_dir: str,
    report_dir: str,
    template_dir: str | None = None,
    fallback_campaign: str = "DEFAULT",
    group: str = "default",
) -> DataFrame:
    """Artifacts found in the folders: ``.csv`` traces, ``.zip`` results, ``.xlsx`` reports."""
    return match_artifacts(
        list_files(spark, trace_dir, ".csv"),
        list_files(spark, result_dir, ".zip"),
        list_files(spark, report_dir, ".xlsx"),
        list_files(spark, template_dir, ".xlsx") if template_dir else None,
        fallback_campaign,
        group,
    )
