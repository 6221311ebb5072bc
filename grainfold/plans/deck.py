"""Work units and their order: a deck of units, each made from samples or other units."""

from __future__ import annotations

import os
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Resources:
    n_cpus: int = 1
    n_gpus: int = 0
    memory: int = 8


@dataclass(frozen=True)
class Unit:
    """sources: names, each with its own filter or the unit's (`only_if`); recipe: steps or the name of one."""

    name: str
    sources: tuple[str, ...]
    filters: tuple[str | None, ...] = ()
    with_annotation: str | None = None
    recipe: object = "default"
    resources: Resources = field(default_factory=Resources)

    @classmethod
    def parse(cls, name: str, doc: dict) -> Unit:
        if "." in name:
            raise ValueError(f"a unit's name has no dots: {name}")
        given = [str(s) for s in doc.get("sources", [])]
        pairs = [(s.split(";", 1) + [doc.get("onlyif")])[:2] if ";" in s else [s, doc.get("onlyif")] for s in given]
        return cls(name, tuple(a.strip() for a, _ in pairs), tuple(b.strip() if b else None for _, b in pairs), doc.get("with_annotation"), doc.get("recipe", "default"), Resources(**doc.get("resources", {})))


@dataclass
class Deck:
    units: dict[str, Unit]

    @classmethod
    def load(cls, folder: str) -> Deck:
        import yaml

        units = {}
        for f in sorted(os.listdir(folder)):
            if f.endswith(".yaml"):
                name = f.removesuffix(".yaml")
                with open(os.path.join(folder, f)) as text:
                    units[name] = Unit.parse(name, yaml.safe_load(text) or {})
        return cls(units)

    def needs(self, name: str) -> list[str]:
        """The sources of a unit that are units themselves; the others are samples."""
        return [s for s in self.units[name].sources if s in self.units]

    def order(self) -> list[str]:
        """Units after their sources; a cycle is an error that names it."""
        done: list[str] = []
        state: dict[str, int] = {}

        def visit(name: str, path: list[str]) -> None:
            if state.get(name) == 2:
                return
            if state.get(name) == 1:
                raise ValueError("a cycle: " + " -> ".join([*path[path.index(name) :], name]))
            state[name] = 1
            for s in self.needs(name):
                visit(s, [*path, name])
            state[name] = 2
            done.append(name)

        for name in self.units:
            visit(name, [])
        return done

    def leaves(self) -> list[str]:
        """Units that no other unit is made from."""
        used = {s for n in self.units for s in self.needs(n)}
        return [n for n in self.units if n not in used]

    def samples(self, name: str) -> list[str]:
        """All samples below a unit, each once."""
        out: list[str] = []
        for s in self.units[name].sources:
            out += self.samples(s) if s in self.units else [s]
        return list(dict.fromkeys(out))


def build(deck: Deck, run: Callable[[Unit], None], *, done: set[str] | None = None, parallel: int = 4, dry_run: bool = False) -> list[str]:
    """Run the units that are not done as soon as their sources are, several at a time in one session.

    Returns the order in which they were started. A dry run starts nothing and
    marks nothing. The first failure is raised after the running units end.
    """
    done = set() if done is None else done
    left = [n for n in deck.order() if n not in done]
    if dry_run:
        return left
    started: list[str] = []
    failed: BaseException | None = None
    with ThreadPoolExecutor(parallel) as pool:
        running: dict = {}
        while left or running:
            ready = [n for n in left if all(s in done for s in deck.needs(n))] if not failed else []
            for n in ready[: parallel - len(running)]:
                left.remove(n)
                started.append(n)
                running[pool.submit(run, deck.units[n])] = n
            if not running:
                break
            for f in wait(running, return_when=FIRST_COMPLETED).done:
                n = running.pop(f)
                if f.exception():
                    failed = failed or f.exception()
                else:
                    done.add(n)
    if failed:
        raise failed
    return started


def split_units(unit: Unit, n_subtrees: int, settings: dict | None = None) -> dict[str, dict]:
    """New work units, one for each subtree of a unit, as documents to write: <name><i> with its filter."""
    return {
        f"{unit.name}{i}": {"sources": [unit.name], "onlyif": f"ws.subtree == {i}", "recipe": unit.recipe, "resources": vars(unit.resources), **(settings or {})}
        for i in range(n_subtrees)
    }
