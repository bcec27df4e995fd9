"""Repeated-value handlers: how the values that share a key become one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERICAL, CATEGORICAL = "NUMERICAL", "CATEGORICAL"


@dataclass(frozen=True)
class Handler:
    """An aggregate over (value, row order), the input types it takes, and the type it gives."""

    name: str
    build: Callable[[Column, Column], Column] | None
    accepts: frozenset[str]
    output: str | None = None

    @property
    def is_aggregator(self) -> bool:
        return self.build is not None

    def output_type(self, input_type: str) -> str:
        return self.output or input_type


def _least(v: Column, _: Column) -> Column:
    """NaN wins, as in IEEE minimum; Spark alone would order it last."""
    return F.when(F.max(F.isnan(v)), F.lit(float("nan"))).otherwise(F.min(v))


_BOTH, _NUMBERS, _CLASSES = frozenset({NUMERICAL, CATEGORICAL}), frozenset({NUMERICAL}), frozenset({CATEGORICAL})
_REGISTRY: dict[str, Handler] = {}


def register_handler(handler: Handler) -> None:
    """Add or replace a handler; the extension point for user-defined aggregates."""
    _REGISTRY[handler.name] = handler


for _h in (
    Handler("FIRST", lambda v, o: F.min_by(v, o), _BOTH),
    Handler("LAST", lambda v, o: F.max_by(v, o), _BOTH),
    Handler("MAX", lambda v, o: F.max(v), _NUMBERS, NUMERICAL),
    Handler("MIN", _least, _NUMBERS, NUMERICAL),
    Handler("SUM", lambda v, o: F.sum(v), _NUMBERS, NUMERICAL),
    Handler("MEAN", lambda v, o: F.avg(v), _NUMBERS, NUMERICAL),
    Handler("COUNT", lambda v, o: F.count(F.lit(1)).cast("double"), _NUMBERS, NUMERICAL),
    # Equal counts: the smallest value.
    Handler("MOST_FREQUENT", lambda v, o: F.mode(v.cast("int"), True).cast("double"), _CLASSES),
    Handler("NONE", None, _BOTH),
):
    register_handler(_h)

#: What "all" stands for.
ALL = ["FIRST", "LAST", "MAX", "MIN", "SUM", "MEAN", "COUNT"]


def handler(name: str) -> Handler:
    try:
        return _REGISTRY[name.upper()]
    except KeyError:
        raise ValueError(f"unknown aggregate function: {name}") from None


def aggregate(name: str, value: str = "v", order: str = "ord") -> Column:
    """The aggregate expression of a handler; NONE has none."""
    found = handler(name)
    if found.build is None:
        raise ValueError("NONE does not aggregate")
    return found.build(F.col(value), F.col(order))


def aggregate_many(names: list[str], value: str = "v", order: str = "ord") -> list[Column]:
    """Several aggregates over the same rows, named after their functions in lower case."""
    return [aggregate(n, value, order).alias(n.lower()) for n in names]


def parse_aggregations(text: str | None) -> list[str]:
    """A list of function names from a command line: nothing is FIRST, ``all`` is all, else a comma list."""
    if not text:
        return ["FIRST"]
    if text.strip().lower() == "all":
        return list(ALL)
    return [handler(t.strip()).name for t in text.split(",")]
