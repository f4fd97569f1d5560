"""Registry of bound queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.catalog.bindings import Tables


@dataclass(frozen=True)
class BoundQuery:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, BoundQuery] = {}


def query(name: str, sql: str | None = None):
    """Register a query under the name of the operator it exercises."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = BoundQuery(name, build, sql)
        return build

    return register


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, so that results compare across engines and partitionings.

    ``floor`` instead of ``round``: the latter goes through decimals, several times slower.
    """
    million = F.lit(1e6)
    return df.select(
        *[
            (F.floor(F.col(f"`{n}`") * million + 0.5) / million).alias(n) if kind == "double" else F.col(f"`{n}`")
            for n, kind in df.dtypes
        ]
    )


def r6(expression: str, name: str | None = None) -> str:
    """SQL twin of ``rounded``, ties included; adding 0.0 turns a negative zero into zero."""
    return f"floor(({expression}) * 1e6 + 0.5) / 1e6 + 0.0 AS {name or expression}"
