"""Registered queries: name -> Spark function and, where SQL can say it, an independent DuckDB statement."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .views import VIEWS


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def sql(*views: str, body: str, ctes: dict[str, str] | None = None) -> str:
    """A statement over named views: WITH RECURSIVE <views and their dependencies>, <ctes> <body>."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        deps, text = VIEWS[name]
        for d in deps:
            add(d)
        done[name] = text

    for v in views:
        add(v)
    done.update(ctes or {})
    head = ", ".join(f"{n} AS (\n{t}\n)" if "(" not in n else f"{n} AS (\n{t}\n)" for n, t in done.items())
    return (f"WITH RECURSIVE {head}\n" if head else "") + body


def query(name: str, operators: str, oracle: str | None = None):
    def wrap(fn):
        REGISTRY[name] = Query(name, operators, fn, oracle)
        return fn

    return wrap
