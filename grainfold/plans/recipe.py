"""Recipes: lists of steps with declared inputs and outputs, run over one set of tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..sources.workspace import Workspace


@dataclass(frozen=True)
class Step:
    """fn(tables, **args) -> {table: DataFrame}. requires: {table: {column: type or None}}; creates: table names."""

    name: str
    fn: Callable
    requires: dict[str, dict[str, str | None]] = field(default_factory=dict)
    creates: tuple[str, ...] = ()


STEPS: dict[str, Step] = {}


def step(requires: dict | None = None, creates: tuple[str, ...] = ()):
    """Register a function as a step under its name."""

    def add(fn: Callable) -> Callable:
        STEPS[fn.__name__] = Step(fn.__name__, fn, requires or {}, tuple(creates))
        return fn

    return add


def check(s: Step, tables: dict[str, DataFrame]) -> None:
    """AttributeError if a table or column is missing, ValueError if its type differs; only schemas are looked at."""
    for table, columns in s.requires.items():
        if table not in tables:
            raise AttributeError(f"{s.name} needs the table {table}")
        kinds = dict(tables[table].dtypes)
        for c, kind in columns.items():
            if c not in kinds:
                raise AttributeError(f"{s.name} needs {table}.{c}")
            if kind is not None and kinds[c] != kind:
                raise ValueError(f"{s.name} needs {table}.{c} as {kind}, not {kinds[c]}")


def fuse(recipe: list[dict]) -> list[dict]:
    """Neighbouring aggregate_vectors steps of one grouping become one, so their rows are grouped once."""
    out: list[dict] = []
    for item in recipe:
        (name, args), = item.items()
        args = dict(args or {})
        if out and name == "aggregate_vectors" and next(iter(out[-1])) == name:
            last = out[-1][name]
            if last.get("by") == args.get("by") and last.get("into") == args.get("into") and not set(last["requests"]) & set(args["requests"]):
                out[-1] = {name: {**last, "requests": {**last["requests"], **args["requests"]}}}
                continue
        out.append({name: args})
    return out


def run(recipe: list[dict], tables: dict[str, DataFrame], *, resume: int = 0, workspace: Workspace | None = None, log: list | None = None) -> dict[str, DataFrame]:
    """Apply the steps from `resume` on; with a workspace what they create is written and read back, and the recipe is logged there."""
    recipe = fuse(recipe)
    for item in recipe:
        name = next(iter(item))
        if name not in STEPS:
            raise ValueError(f"no step {name}; there are {', '.join(sorted(STEPS))}")
    for i, item in enumerate(recipe[resume:], resume):
        (name, args), = item.items()
        s = STEPS[name]
        check(s, tables)
        began = time.time()
        made = s.fn(tables, **(args or {}))
        absent = set(s.creates) - set(made)
        if absent:
            raise ValueError(f"{name} did not make {', '.join(sorted(absent))}")
        if workspace:
            made = {k: workspace.write(k, v) for k, v in made.items()}
        tables = {**tables, **made}
        if log is not None:
            log.append((i, name, round(time.time() - began, 3)))
        if workspace:
            workspace.write("recipe_log", workspace.spark.createDataFrame([(i, name, repr(args))], "position int, step string, args string"), "append")
    return tables
