"""Parameters of the engine, and their overriding."""

from __future__ import annotations

import dataclasses
from typing import Any


@dataclasses.dataclass(frozen=True)
class Params:
    """Defaults of operators, all of which can be given to the operators themselves."""

    tib_window: int = 500
    sequence_length: int = 512
    atr_rows: int = 14
    barrier_rows: int = 900
    barrier_multiple: float = 2.0
    purge: int = 3600
    embargo: int = 5000
    splits: int = 6
    daily_drawdown_usd: float = 125.0
    total_drawdown_usd: float = 250.0
    profit_lock: float = 0.02
    initial_equity: float = 5000.0
    kalman_noise: float = 1e-4
    kalman_density: float = 1e-5
    cusum_window: int = 60
    cusum_alpha: float = 0.02

    def override(self, *layers: dict[str, Any]) -> Params:
        """The parameters after layers of settings, of which later ones win; unknown names are an error."""
        merged: dict[str, Any] = {}
        for layer in layers:
            merged |= layer
        kinds = {f.name: type(getattr(self, f.name)) for f in dataclasses.fields(self)}
        if unknown := set(merged) - set(kinds):
            raise KeyError(f"unknown parameters: {sorted(unknown)}")
        return dataclasses.replace(self, **{k: kinds[k](v) for k, v in merged.items()})

    def from_session(self, spark, prefix: str = "tickloom.") -> Params:
        """The parameters after what the session's settings say under a prefix."""
        names = (f.name for f in dataclasses.fields(self))
        found = {n: v for n in names if (v := spark.conf.get(prefix + n, None)) is not None}
        return self.override(found)
