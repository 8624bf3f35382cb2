"""Cost of extraction runs, and the time that a driver may take."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cost_table(runs: DataFrame) -> DataFrame:
    """Hours for 1000 respondents and milliseconds for one, from (n_respondents, elapsed_seconds); 0 without respondents."""
    each = F.when(F.col("n_respondents") > 0, F.col("elapsed_seconds") / F.col("n_respondents")).otherwise(0.0)
    return runs.withColumn("gpu_hours_per_1k", each * 1000.0 / 3600.0).withColumn("latency_ms_per_respondent", each * 1000.0)


def mixed_cost(first: Column, second: Column, share: Column) -> Column:
    """Cost where ``share`` (0 to 1) of the items goes to the first method; other shares fail."""
    return F.when(share.between(0.0, 1.0), share * first + (1 - share) * second).otherwise(F.raise_error(F.lit("share must be 0 to 1")).cast("double"))


class TimeBudget:
    """M2: seconds that a driver loop may take; asked before each further batch."""

    def __init__(self, seconds: float, clock=time.monotonic):
        self.seconds, self.clock = seconds, clock
        self.began = clock()

    def left(self) -> float:
        return max(0.0, self.seconds - (self.clock() - self.began))

    def spent(self) -> bool:
        return self.left() <= 0


def timed(method: str, k: int, n_respondents: int, n_passes: int, work, clock=time.monotonic) -> tuple[object, dict]:
    """The result of ``work()`` and its cost record."""
    began = clock()
    out = work()
    return out, {"method": method, "k": k, "n_respondents": n_respondents, "n_forward_passes": n_passes, "elapsed_seconds": clock() - began}
