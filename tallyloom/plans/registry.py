"""The model registry: a build function, its SQL oracle and its tags."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyloom.session import configure
from tallyloom.sources.readers import Tables


@dataclass(frozen=True)
class Model:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    tags: tuple[str, ...]

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(configure(spark), folder))


MODELS: dict[str, Model] = {}


def model(name: str, sql: str | None = None, tags: tuple[str, ...] = ()):
    """Register a function ``Tables -> DataFrame`` as a model."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in MODELS:
            raise ValueError(f"model {name!r} is registered twice")
        MODELS[name] = Model(name, build, sql, (name.split("_")[0], *tags))
        return build

    return register


def tagged(tag: str) -> list[Model]:
    """Models that carry a tag."""
    return [m for m in MODELS.values() if tag in m.tags]


# Pieces of oracle SQL that many models share.


def cents(column: str) -> str:
    return f"CAST(ROUND({column} * 100) AS BIGINT)"


def dollars(minor: str) -> str:
    return f"CAST({minor} AS DOUBLE) / 100.0"


LINE_UNITS = (
    "CAST(ROUND(l_extendedprice * 100) AS BIGINT)"
    " * (100 - CAST(ROUND(l_discount * 100) AS BIGINT))"
)
ORDER_DAY = "CAST(o_orderdate AS DATE)"
AS_OF = "2001-12-31"
EVENTS_AS_OF = "2024-01-31"
