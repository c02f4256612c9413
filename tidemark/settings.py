"""Settings of the analytic operators."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FeatureSettings:
    momentum: int = 250
    skip: int = 20
    volatility: int = 60
    liquidity: int = 60
    short_mean: int = 20
    long_mean: int = 100
    sessions_a_year: int = 250

    @property
    def needed(self) -> int:
        """Sessions before the first ranking."""
        return self.momentum + 1

    @property
    def look_back(self) -> int:
        """Earlier sessions that a row's features depend on; a return needs one more than its window."""
        return max(self.momentum, self.volatility, self.liquidity - 1, self.short_mean - 1, self.long_mean - 1)


@dataclass(frozen=True)
class RankingSettings:
    least_liquidity: float = 1_000_000.0
    least_sector: int = 5
    weights: dict[str, float] = field(default_factory=lambda: {"momentum": 0.5, "trend": 0.3, "volatility": -0.2})


@dataclass(frozen=True)
class BacktestSettings:
    positions: int = 10
    step: int = 60
    delay: int = 1
    fee_percent: float = 1.0
    impact_percent: float = 0.5

    @property
    def unit_cost(self) -> float:
        return (self.fee_percent + self.impact_percent) / 100


@dataclass(frozen=True)
class LearningSettings:
    horizon: int = 60
    folds: int = 4
    least_rows: int = 400
    penalty: float = 0.1


@dataclass(frozen=True)
class ExternalSettings:
    window: int = 60
    lag: int = 40


@dataclass(frozen=True)
class SweepSettings:
    horizons: tuple[int, ...] = (20, 60, 120)
    least_members: int = 4
    discovery_rate: float = 0.10
    least_season_members: int = 8
