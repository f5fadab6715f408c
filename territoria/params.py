"""Parameters of the flow: one validated object and its column forms.

Settings come as plain mappings (no file reader is part of the engine). A
parameter either is a literal of the plan or is looked up per row, e.g. a
simultaneity for every row's scenario name.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# --- fixed values (must equal the reference defaults) ---------------------
DEFAULT_SIMULTANEITY = 0.3
DEFAULT_SCENARIOS = {"bajo": 0.2, "medio": 0.3, "alto": 0.5}
DEFAULT_SCENARIO_NAME = "medio"
DEFAULT_HORIZONS = [5, 10, 15, 20, 30]
DEFAULT_WEIGHTS = {
    "demanda": 0.40,
    "crecimiento_ev": 0.30,
    "soporte_hidraulico": 0.15,
    "cobertura_hidraulica": 0.05,
}
# names of the settings
SCENARIOS_KEY, SCENARIO_KEY = "simultaneidad", "default_scenario"
HORIZONS_KEY, WEIGHTS_KEY = "forecast_horizons_anios", "weights"
# ---------------------------------------------------------------------------


class ParameterError(ValueError):
    """A setting that cannot be read as what it should be."""


def _numbers(what: str, values: Mapping) -> dict[str, float]:
    out = {}
    for name, value in values.items():
        try:
            out[str(name)] = float(value)
        except (TypeError, ValueError) as e:
            raise ParameterError(f"{what} '{name}' is not a number: {value!r}") from e
    return out


def _years_ahead(values: Iterable) -> tuple[int, ...]:
    """Distinct positive whole years in order; none left means the defaults."""
    kept = set()
    for value in values:
        try:
            kept.add(int(value))
        except (TypeError, ValueError) as e:
            raise ParameterError(f"horizon is not a whole number of years: {value!r}") from e
    return tuple(sorted(y for y in kept if y > 0)) or tuple(DEFAULT_HORIZONS)


@dataclass(frozen=True)
class FlowParams:
    """Typed parameters; every way to build one ends in the same checks."""

    simultaneity: float = DEFAULT_SIMULTANEITY
    horizons: tuple[int, ...] = tuple(DEFAULT_HORIZONS)
    scenarios: Mapping[str, float] = None
    weights: Mapping[str, float] = None
    scenario_label: str = DEFAULT_SCENARIO_NAME
    renormalise_weights: bool = False

    def __post_init__(self):
        own = object.__setattr__
        own(self, "simultaneity", _numbers("simultaneity", {"": self.simultaneity})[""])
        own(self, "horizons", _years_ahead(self.horizons or ()))
        own(self, "scenarios", _numbers("scenario", self.scenarios or DEFAULT_SCENARIOS))
        known = {k: v for k, v in (self.weights or {}).items() if k in DEFAULT_WEIGHTS}
        own(self, "weights", _numbers("weight", {**DEFAULT_WEIGHTS, **known}))

    @classmethod
    def configured(cls, settings: Mapping | None = None, scenario: str | None = None,
                   simultaneity: float | None = None, horizons: Iterable | None = None) -> FlowParams:
        """From a settings mapping; explicit arguments come before it."""
        given = settings or {}
        params = cls(scenarios=given.get(SCENARIOS_KEY), weights=given.get(WEIGHTS_KEY),
                     horizons=horizons or given.get(HORIZONS_KEY) or ())
        offered = _numbers("scenario", given.get(SCENARIOS_KEY) or {})
        return replace(params, simultaneity=cls._choose(offered, scenario or given.get(SCENARIO_KEY), simultaneity))

    @staticmethod
    def _choose(offered: Mapping[str, float], name: str | None, fixed: float | None) -> float:
        if fixed is None and name is not None and name not in offered:
            log.warning("scenario %r is not among %s; simultaneity stays %s", name, sorted(offered), DEFAULT_SIMULTANEITY)
        return fixed if fixed is not None else offered.get(name, DEFAULT_SIMULTANEITY)

    def effective_weights(self) -> dict[str, float]:
        total = sum(self.weights.values()) if self.renormalise_weights else 1.0
        return {k: v / (total or 1.0) for k, v in self.weights.items()}

    # ---- the same rules for values that stand in rows ----------------------
    def simultaneity_of(self, scenario: Column, fixed: Column | None = None) -> Column:
        """Per row: the fixed value, else the named scenario's, else the default."""
        table = F.create_map(*[F.lit(x) for kv in self.scenarios.items() for x in kv])
        found = [table[scenario], F.lit(DEFAULT_SIMULTANEITY)]
        return F.coalesce(*([fixed.cast("double")] if fixed is not None else []), *found)

    def weighted(self, criteria: Mapping[str, Column]) -> Column:
        """Weighted sum of the criteria that have a weight."""
        weights = self.effective_weights()
        return sum((F.lit(weights[k]) * c for k, c in criteria.items() if k in weights), F.lit(0.0))
