"""Currency cost of a decline decision, in exact decimals."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CostModel:
    """Assumed unit costs. The defaults are the fixed values every published figure rests on."""

    chargeback_fee: Decimal = Decimal("25")
    margin_rate: Decimal = Decimal("0.025")
    churn_probability: Decimal = Decimal("0.05")
    lifetime_value: Decimal = Decimal("200")
    review: Decimal = Decimal("2")

    @property
    def false_decline(self) -> Decimal:
        """Expected churn loss of one wrongly declined customer."""
        return self.churn_probability * self.lifetime_value


DEFAULT_COSTS = CostModel()


def money(value: Decimal | int | str, scale: int = 6) -> Column:
    return F.lit(Decimal(value)).cast(f"decimal(18,{scale})")


def decision_cost(declined: Column, label: Column, amount: Column,
                  costs: CostModel = DEFAULT_COSTS) -> Column:
    """Cost of one decision as decimal(18,6).

    Approved and bad: the amount plus the chargeback fee. Declined and good: lost margin plus
    churn. Every decline, right or wrong, also pays a review.
    """
    amt = amount.cast("decimal(18,3)")
    missed = amt + money(costs.chargeback_fee)
    turned_away = amt * F.lit(costs.margin_rate).cast("decimal(6,3)") + money(costs.false_decline)
    zero, review = money(0), money(costs.review)
    return (F.when(declined, F.when(label == 0, turned_away).otherwise(zero) + review)
            .otherwise(F.when(label == 1, missed).otherwise(zero))).cast("decimal(18,6)")


def threshold_grid(low: float = 0.001, high: float = 0.99, even: int = 990,
                   geometric: int = 400) -> list[float]:
    """Sorted distinct decline thresholds: an even grid refined at the low end."""
    merged = set(np.linspace(low, high, even).tolist()) | set(np.geomspace(low, high, geometric).tolist())
    return sorted(merged)
