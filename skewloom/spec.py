"""Settings as explicit values: vocabularies, privacy settings and column roles, so that several datasets fit one session."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Vocabulary:
    """Closed vocabularies in their order, and the fallback of each attribute."""

    options: Mapping[str, Sequence[str]]
    fallback: Mapping[str, str]

    @classmethod
    def from_table(cls, options: DataFrame) -> Vocabulary:
        """From (attr, ord, option_value, is_fallback); vocabularies are small by nature, and checked to be."""
        rows = options.select("attr", "ord", "option_value", "is_fallback").limit(10_001).collect()
        if len(rows) > 10_000:
            raise ValueError("a closed vocabulary may have 10,000 options")
        own: dict[str, list[str]] = {}
        fallback = {}
        for r in sorted(rows, key=lambda r: (r["attr"], r["ord"])):
            own.setdefault(r["attr"], []).append(r["option_value"])
            if r["is_fallback"]:
                fallback[r["attr"]] = r["option_value"]
        return cls(own, fallback)


@dataclass(frozen=True)
class Dataset:
    """Column roles of a text table and the (rounds, noise) of each privacy budget."""

    attributes: Sequence[str]
    class_attributes: Sequence[str] = ()
    blind_attributes: Sequence[str] = ()
    text: str = "text"
    row_id: str = "row_id"
    class_id: str | None = None
    budgets: Mapping[float, tuple[int, float]] = field(default_factory=dict)
    files: Mapping[str, str] = field(default_factory=dict)

    @property
    def candidates(self) -> list[str]:
        """Attributes that may be blind: all but those that the vote sees as its class."""
        return [a for a in self.attributes if a not in self.class_attributes]

    def budget(self, epsilon: float) -> tuple[int, float]:
        """(rounds, noise) of a privacy budget."""
        if epsilon not in self.budgets:
            raise KeyError(f"no setting for epsilon {epsilon}; there are {sorted(self.budgets)}")
        return self.budgets[epsilon]


def rescale_noise(sigma: float, votes_from: int, votes_to: int) -> float:
    """The noise that spends the same zero-concentrated budget on another number of votes."""
    return sigma * math.sqrt(votes_to / votes_from)


def scheduled_strength(t: int, last: int, strength: float, schedule: str = "constant") -> float:
    """The quota strength of round t: constant, or rising linearly to ``strength`` in the last round."""
    if schedule == "constant" or last == 0:
        return strength
    if schedule == "linear":
        return strength * t / last
    raise ValueError(f"unknown schedule {schedule}")


#: Fixed values: (rounds, noise) by epsilon of the two published settings of the first dataset.
TAGGED_BUDGETS = {4.0: (4, 2.5788), 2.0: (4, 4.7482), 1.0: (2, 6.8692), math.inf: (9, 0.0)}
PLAIN_BUDGETS = {4.0: (9, 3.2144), 2.0: (9, 5.8721), 1.0: (9, 10.8896), math.inf: (9, 0.0)}
#: Survivors, variations of each, neighbours, repeats, attributes shown.
SURVIVORS, VARIATIONS, NEIGHBOURS, REPEATS, SHOWN = 2000, 6, 5, 20, 3
