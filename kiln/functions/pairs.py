"""Column pairs that names suggest: one table of rules, one matcher."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import product

from kiln.functions import names as N


@dataclass(frozen=True)
class PairRule:
    """Two different columns, the first named like ``left`` and the second like ``right``."""
    kind: str
    left: tuple[re.Pattern[str], ...]
    right: tuple[re.Pattern[str], ...]
    name: str | Callable[[str, str], str] = ""
    left_types: frozenset[str] | None = None
    right_types: frozenset[str] | None = None
    priority: str = ""

    def fits(self, a: str, b: str, types: dict[str, str] | None = None) -> bool:
        named = any(N.matches(p, a) for p in self.left) and any(N.matches(p, b) for p in self.right)
        typed = types is None or all(allowed is None or types[c] in allowed for c, allowed in (
            (a, self.left_types), (b, self.right_types)))
        return a != b and named and typed

    def label(self, a: str, b: str) -> str:
        raw = self.name(a, b) if callable(self.name) else self.name.format(a=a, b=b)
        return re.sub(r"[^\w]", "_", raw)


def _per_unit(a: str, b: str) -> str:
    unit = N.matches(N.RATIO_REVENUE, a) and re.search("unit|qty", b, re.I)
    return f"{a}_Per_Unit" if unit else f"{a}_Per_{b}"


_NUMBER, _DATE = frozenset(("numerical",)), frozenset(("datetime",))

DATE_RULES = (
    PairRule("duration", (N.FE_START_DATE,), (N.FE_END_DATE,)),
    PairRule("duration", (N.ORDER_DATE,), (N.DELIVERY_DATE,)),
    PairRule("age", (N.BIRTH_DATE,), (N.REFERENCE_DATE,)),
)
_MONEY = (N.RATIO_INCOME, N.FE_SALARY, N.RATIO_REVENUE)
RATIO_RULES = (
    PairRule("ratio", _MONEY, (N.FE_EXPERIENCE,), "{a}_Per_{b}"),
    PairRule("ratio", _MONEY, (N.RATIO_QUANTITY,), _per_unit),
)
RELATION_RULES = (
    PairRule("body_ratio", (N.FE_HEIGHT,), (N.FE_WEIGHT,), "", _NUMBER, _NUMBER, "HIGH"),
    PairRule("pay_per_experience", (N.FE_SALARY,), (N.FE_EXPERIENCE,), "", _NUMBER,
             frozenset(("numerical", "categorical")), "MEDIUM"),
    PairRule("duration", (N.FE_START_DATE,), (N.FE_END_DATE,), "", _DATE, _DATE, "HIGH"),
)


def matching(rules: Iterable[PairRule], columns: list[str], types: dict[str, str] | None = None
             ) -> list[tuple[PairRule, str, str]]:
    """Every (rule, first, second) that fits, rule by rule in column order."""
    return [(r, a, b) for r, a, b in product(rules, columns, columns) if r.fits(a, b, types)]
