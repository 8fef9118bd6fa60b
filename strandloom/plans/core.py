"""How queries are registered: a function of the stand-in views, and SQL with {stand-ins}."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.plans.standins import Views, fill


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums differ in their last digits by order."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Registers ``f(views)`` under its name."""

        def put(f):
            self.queries[f.__name__] = lambda spark, sf_dir: rounded(f(Views(spark, sf_dir)))
            if sql:
                self.oracles[f.__name__] = fill(sql)
            return f

        return put


def norm_two_sided(z: str) -> str:
    """SQL of the two-sided normal tail of a column, by the series of the distribution function (all terms positive)."""
    terms = f"list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(abs({z})) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))))"
    return f"CASE WHEN {z} IS NULL THEN NULL WHEN abs({z}) > 8 THEN 0.0 WHEN {z} = 0 THEN 1.0 ELSE greatest(0.0, 1 - 2 * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {terms}) END"


def _beta_series(x: str, a: str, b: str) -> str:
    """SQL of the regularised incomplete beta function for x below its middle, by its power series."""
    lead = f"exp({a} * ln({x}) + {b} * ln(1 - {x}) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b}))"
    terms = f"list_sum(list_transform(range(0, 1500), lambda k: exp(lgamma({a} + {b} + k) - lgamma({a} + {b}) - lgamma({a} + 1 + k) + lgamma({a} + 1) + k * ln({x}))))"
    return f"({lead} * {terms})"


def t_two_sided(t: str, df: str) -> str:
    """SQL of the two-sided tail of Student's t of two columns."""
    x, y = f"({df} / ({df} + {t} * {t}))", f"({t} * {t} / ({df} + {t} * {t}))"
    low, high = _beta_series(x, f"({df} / 2.0)", "0.5"), _beta_series(y, "0.5", f"({df} / 2.0)")
    return f"CASE WHEN {t} IS NULL OR {df} IS NULL OR {df} <= 0 THEN NULL WHEN {t} = 0 THEN 1.0 WHEN {x} <= ({df} / 2.0 + 1) / ({df} / 2.0 + 2.5) THEN {low} ELSE 1 - {high} END"


def bh(table: str, p: str = "p", key: str = "*") -> str:
    """SQL of a table with q, the BH value of p over all rows whose p isn't null."""
    return f"(SELECT {key}, CASE WHEN {p} IS NOT NULL THEN min(least(1.0, {p} * m / r)) OVER (ORDER BY {p} DESC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS q FROM (SELECT *, count({p}) OVER () AS m, count({p}) OVER (ORDER BY {p} NULLS LAST) AS r FROM {table}))"
