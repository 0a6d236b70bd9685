"""Named queries with their parameters, and the SQL that states each one's result independently."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from textloom.plans.params import Param, bind

STABILITY = {"experimental": 0, "beta": 1, "stable": 2}


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[..., DataFrame]
    oracle: str | None = None
    category: str = "general"
    stability: str = "stable"
    description: str = ""
    params: tuple[Param, ...] = ()
    tags: tuple[str, ...] = field(default_factory=tuple)


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, category: str = "general", params: tuple[Param, ...] = (), stability: str = "stable", tags: tuple[str, ...] = ()):
    """Registers build(spark, sf_dir, **params) under a name; the first line of its docstring describes it."""

    def add(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, oracle, category, stability, (build.__doc__ or "").split("\n")[0], tuple(params), tuple(tags))
        return build

    return add


def run(spark: SparkSession, name: str, sf_dir: str, **params) -> DataFrame:
    """The query's DataFrame with checked parameters; unknown names and bad values raise before a plan is made."""
    if name not in QUERIES:
        raise KeyError(f"unknown query: {name}")
    own = QUERIES[name]
    return own.build(spark, sf_dir, **bind(own.params, params))


def select(category: str | None = None, stability: str | None = None, least: str | None = None) -> list[Query]:
    """Queries of a category and stability, or of a stability of at least ``least``."""
    return [
        q
        for q in QUERIES.values()
        if (category is None or q.category == category)
        and (stability is None or q.stability == stability)
        and (least is None or STABILITY[q.stability] >= STABILITY[least])
    ]


def by_category() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for q in QUERIES.values():
        out.setdefault(q.category, []).append(q.name)
    return out


def find(term: str) -> list[str]:
    """Names of the queries whose name, description, category or tags hold a term, in any case."""
    return [q.name for q in QUERIES.values() if term.lower() in " ".join((q.name, q.description, q.category, *q.tags)).lower()]
