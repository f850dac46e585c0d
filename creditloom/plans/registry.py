"""Registered queries: a Spark function and, where SQL can say it, an equal DuckDB text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .bridge import BRIDGE, Tables, tables
from .oracle import SHARED


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def with_ctes(body: str) -> str:
    """The body behind every shared table it names, in definition order."""
    texts = {**BRIDGE, **SHARED}
    wanted: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"[a-z_0-9]+", todo.pop()))
        new = (words & texts.keys()) - wanted
        wanted |= new
        todo.extend(texts[name] for name in new)
    # A braced name is a driver table.
    ctes = [f"{name} AS ({re.sub(r'{([a-z]+)}', r'\1', texts[name])})" for name in texts if name in wanted]
    if not ctes:
        return body
    rest = f", {body[5:]}" if body.startswith("WITH ") else f" {body}"
    return f"WITH {', '.join(ctes)}{rest}"


def query(name: str, sql: str | None = None):
    """Register ``fn(t)``, where ``t`` gives the driver tables and the views over them."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Query(lambda spark, sf_dir: fn(tables(spark, sf_dir)), None if sql is None else with_ctes(sql.strip()))
        return fn

    return register
