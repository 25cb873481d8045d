"""Ordered rule tables over facts: the first rule that fits names the kind."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Rule:
    """Fits if every flag has the value given and every number lies at or above / below its bound.

    A fact that is None fits no bound.
    """
    kind: Any
    flags: dict[str, bool] = field(default_factory=dict)
    least: dict[str, float] = field(default_factory=dict)
    below: dict[str, float] = field(default_factory=dict)

    def fits(self, facts: Any) -> bool:
        number = lambda name: getattr(facts, name)
        return (all(bool(getattr(facts, k)) is v for k, v in self.flags.items())
                and all(number(k) is not None and number(k) >= v for k, v in self.least.items())
                and all(number(k) is not None and number(k) < v for k, v in self.below.items()))


def fitting(rules: Iterable[Rule], facts: Any) -> list[Any]:
    """The kinds of all rules that fit, in order."""
    return [r.kind for r in rules if r.fits(facts)]


def decide(rules: Iterable[Rule], facts: Any) -> Any:
    """The kind of the first rule that fits; None if none does."""
    return next((r.kind for r in rules if r.fits(facts)), None)
