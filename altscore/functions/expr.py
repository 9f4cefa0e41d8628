"""Reusable column expressions (all JVM-side, no Python UDFs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c








def isin_or_false(c, values) -> Column:
    """``c IN values`` where NULL counts as not in (pandas ``isin``)."""
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def rlike_ci(c, pattern: str) -> Column:
    """Case-insensitive regex search; NULL never matches."""
    return F.coalesce(col(c).rlike("(?i)" + pattern), F.lit(False))




def clip(c, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(c)))




def add_all(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def to_ntz(c) -> Column:
    """Timestamp to TIMESTAMP_NTZ (UTC wall time) for zone-free output."""
    return col(c).cast("timestamp_ntz")


def rnd(c, n: int) -> Column:
    """Round half-to-even at ``n`` decimals, computed as ``bround(x*10^n)/10^n``.

    The product is an IEEE double in every engine, so the result is
    reproducible outside Spark, and ties go to even like Python's ``round``.
    (``F.round`` rounds the shortest decimal string half-up, which moves
    values like 39.105 -> 39.11 where the binary value is below the tie.)
    """
    scale = float(10 ** n)
    return F.bround(col(c) * F.lit(scale), 0) / F.lit(scale)


# ---- Spark SQL text builders ------------------------------------------------
# Wide projections are written as SQL expression strings: one JVM call per
# output column instead of one per operator node, which keeps plan building
# cheap for the 45-feature plans.  Decimal-looking literals carry the ``D``
# suffix so they are doubles (a bare ``2.5`` is a DECIMAL in Spark SQL).

def sql_rnd(x: str, n: int) -> str:
    """SQL twin of :func:`rnd`."""
    s = f"{float(10 ** n)!r}D"
    return f"(bround(({x}) * {s}, 0) / {s})"


def sql_months(t0: str, t1: str) -> str:
    """Span in 30-day months of whole days between two timestamps, at least 1."""
    return f"greatest(1.0D, CAST(timestampdiff(DAY, {t0}, {t1}) AS DOUBLE) / 30.0D)"


def sql_in(col_: str, values) -> str:
    """``col IN (...)`` with NULL as not in."""
    return f"coalesce({col_} IN (" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "), false)"


def sql_d(x: float) -> str:
    return f"{float(x)!r}D"
