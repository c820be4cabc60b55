"""Passes by name: each is a pure query from facts to findings."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..facts import Facts


@dataclass(frozen=True)
class Pass:
    name: str
    category: str
    run: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    default: bool = True  # runs unless named otherwise
    together: Callable[..., DataFrame] | None = None  # takes the facts and the names of all chosen passes that share it, and runs them as one plan


PASSES: dict[str, Pass] = {}


def register(name: str, category: str, needs: tuple[str, ...] = (), default: bool = True, together: Callable[..., DataFrame] | None = None):
    """Decorator. A pass may need others, which must be registered before it; one that is not a default runs only when it is named."""

    def put(f):
        missing = [n for n in needs if n not in PASSES]
        if missing or name in PASSES:
            raise ValueError(f"{name}: {'needs ' + ', '.join(missing) if missing else 'registered already'}")
        PASSES[name] = Pass(name, category, f, needs, default, together)
        return f

    return put


def run(facts: Facts, names: Iterable[str] | None = None, disabled: Iterable[str] = (), options: dict[str, dict] | None = None) -> DataFrame:
    """The findings of the named passes (all defaults if none is named) but the disabled ones, as one frame.

    Passes that share a plan and have no options run as one, so that all line rules read the lines once.
    """
    from . import load

    load()
    chosen = [n for n in (names or [n for n, p in PASSES.items() if p.default]) if n not in set(disabled)]
    out = facts.spark.createDataFrame([], facts.findings.schema)
    shared: dict[Callable[..., DataFrame], list[str]] = {}
    for n in chosen:
        own = (options or {}).get(n, {})
        if PASSES[n].together and not own:
            shared.setdefault(PASSES[n].together, []).append(n)
        else:
            out = out.unionByName(PASSES[n].run(facts, **own))
    for together, names_ in shared.items():
        out = out.unionByName(together(facts, names_))
    return out
