"""Landed CSV, JSON and web-page files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline import schemas


def read_game_log_csv(spark: SparkSession, path: str, schema: str = schemas.GAME_LOG) -> DataFrame:
    """Headerless comma-separated game log with declared names; the first row is data."""
    return spark.read.schema(schema).option("header", False).csv(path)


def read_json_rows(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Files that hold a JSON array of flat records, one row per record.

    A multi-line document is read by one task per file. Land large sources with one array or
    record per line and pass ``multi_line=False``, so that files split.
    """
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def extract_embedded_json(pages: DataFrame, element: str, html: str = "html") -> DataFrame:
    """Rows of the JSON array in ``data = (...);`` of each page; pages without it give none.

    The match is greedy to the last ``;`` of the line.
    """
    text = F.regexp_extract(html, r"data = (.*);", 1)
    rows = F.from_json(text, f"array<struct<{_as_struct(element)}>>")
    return pages.filter(F.contains(F.col(html), F.lit("data = "))).select(F.inline(rows))


def extract_embedded_maps(pages: DataFrame, html: str = "html") -> DataFrame:
    """Elements of the JSON array in ``data = (...);`` of each page as maps of text, column ``fields``: no field is lost
    because it was not declared."""
    text = F.regexp_extract(html, r"data = (.*);", 1)
    rows = F.from_json(text, "array<map<string, string>>")
    return pages.filter(F.contains(F.col(html), F.lit("data = "))).select(F.explode(rows).alias("fields"))


def _as_struct(element: str) -> str:
    fields = [f.strip().split(" ", 1) for f in element.split(",")]
    return ", ".join(f"{name}: {kind}" for name, kind in fields)
