"""The ledger features kept up to date by increments (FP1 / T1).

Three logs of newest rows (``KeyedLog``), each changed only for the applicants that an
increment touches:

* ``sums``: accumulators that merge exactly: counts, decimal sums, sums of squares, sums of
  days and of days times amount, first and last times, extremes;
* ``values``: how often each amount (credit, debit) and each credit source of
  an applicant occurs, for quartiles, spikes and distinct sources;
* ``features``: the raw inputs and what follows from them.

An increment is aggregated, merged with what the logs hold of its applicants, and the
features of these are computed again.  The ledger before it is not read, with one
exception: the income trend counts whole days from an applicant's first credit, so
where an increment brings an earlier one, that applicant's credits are read again from
``history``.

Moments are formed from exact sums, so the result does not depend on how the ledger was cut.
A batch that is replayed reads the logs as they were before it, so it may stop anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import sql_in
from ..session import stored
from ..streaming.keyed_log import KeyedLog
from .ledger_features import CR, DR, HEAVY_KEY_ROWS, KEY, LEDGER_FEATURES, features_from_aggregates
from .ordered import keyed_exact_quantiles

RAW = ("n_cr", "sum_cr", "sum_dr")
_MONEY, _SQUARES = "decimal(38,2)", "decimal(38,4)"


def _when(cond: str, value: str) -> str:
    return f"CASE WHEN {cond} THEN {value} END"


def _conditions() -> dict[str, str]:
    card = f"coalesce(message RLIKE '(?i){K.CARD_PATTERN}', false)"
    return {"n_all": "true", "n_cr": CR, "n_dr": DR, "n_cr_amount": f"{CR} AND amount IS NOT NULL", "n_dr_amount": f"{DR} AND amount IS NOT NULL",
            "n_bill2": f"{DR} AND {sql_in('source', K.BILLS2)}", "n_bill3": f"{DR} AND {sql_in('source', K.BILLS3)}",
            "n_emi": f"{DR} AND coalesce(source = '{K.EMI_SOURCE}', false)",
            "n_failed": f"coalesce(message RLIKE '(?i){K.FAILED_PATTERN}', false)",
            "n_card_dr": f"{card} AND {DR}", "n_card_cr": f"{card} AND {CR}"}


def _sums() -> dict[str, tuple[str, str]]:
    """name -> (type, expression of a row) of what is summed, without the days."""
    out = {n: ("bigint", f"CAST(coalesce({c}, false) AS BIGINT)") for n, c in _conditions().items()}
    ess5, ess6 = sql_in("source", K.ESSENTIAL5), sql_in("source", K.ESSENTIAL6)
    for n, c in {"sum_cr": CR, "sum_dr": DR, "sum_ess5": f"{DR} AND {ess5}", "sum_discr": f"{DR} AND NOT {ess6}"}.items():
        out[n] = (_MONEY, f"CAST({_when(c, 'amount')} AS {_MONEY})")
    for n, c in {"sq_cr": CR, "sq_dr": DR}.items():
        out[n] = (_SQUARES, f"CAST({_when(c, 'amount * amount')} AS {_SQUARES})")
    return out


_TIMES = {"cr": CR, "dr": DR, "bill2": _conditions()["n_bill2"], "emi": _conditions()["n_emi"], "bill3": _conditions()["n_bill3"]}
_DAYS = {"days": "decimal(38,0)", "days2": "decimal(38,0)", "days_cr": _MONEY}
_LEAST = {f"{n}_t0": ("timestamp", _when(c, "ts")) for n, c in _TIMES.items()} | {"cr_min": ("decimal(18,2)", _when(CR, "amount"))}
_MOST = {f"{n}_t1": ("timestamp", _when(c, "ts")) for n, c in _TIMES.items()} | {"cr_max": ("decimal(18,2)", _when(CR, "amount"))}

SUMS_SCHEMA = ", ".join([f"{KEY} long"] + [f"{n} {t}" for n, (t, _) in (_sums() | _LEAST | _MOST).items()] + [f"{n} {t}" for n, t in _DAYS.items()])
VALUES_SCHEMA = f"{KEY} long, kind string, item string, n long"
FEATURES_SCHEMA = ", ".join([f"{KEY} long", "n_cr long", f"sum_cr {_MONEY}", f"sum_dr {_MONEY}"] + [f"{f} double" for f in LEDGER_FEATURES])


def _days(rows: DataFrame) -> DataFrame:
    """Sums over credits of whole days since ``first``, their squares, and days times amount, by applicant."""
    day = "CAST(timestampdiff(DAY, first, ts) AS DECIMAL(10,0))"
    fit = rows.where(f"{CR} AND amount IS NOT NULL AND ts IS NOT NULL AND first IS NOT NULL")
    return fit.groupBy(KEY).agg(F.expr(f"CAST(sum({day}) AS {_DAYS['days']}) AS days"),
                                F.expr(f"CAST(sum({day} * {day}) AS {_DAYS['days2']}) AS days2"),
                                F.expr(f"CAST(sum({day} * amount) AS {_DAYS['days_cr']}) AS days_cr"))


def _deviation(n: str, total: str, squares: str) -> str:
    """Sample standard deviation from exact sums (null below two)."""
    spread = f"CAST(CAST({n} AS DECIMAL(19,0)) * {squares} - {total} * {total} AS DOUBLE)"
    return _when(f"{n} > 1", f"sqrt(greatest(0.0D, {spread}) / (CAST({n} AS DOUBLE) * ({n} - 1)))")


class FeatureStore:
    def __init__(self, spark: SparkSession, root: str):
        def log(name, keys, schema):
            return KeyedLog(spark, f"{root.rstrip('/')}/{name}", keys, spark.createDataFrame([], schema).schema)
        self.spark = spark
        self.sums = log("sums", [KEY], SUMS_SCHEMA)
        self.values = log("values", [KEY, "kind", "item"], VALUES_SCHEMA)
        self.features = log("features", [KEY], FEATURES_SCHEMA)

    def add(self, rows: DataFrame, batch_id: int, history: DataFrame | None = None) -> None:
        """Takes in the ledger rows of a batch; batches are numbered upwards.

        ``history`` holds all rows before this batch; it is read only for applicants whose first credit moves.
        """
        new = stored(rows.select(KEY, "ts", "txn_type", "amount", "source", "message").where(F.col(KEY).isNotNull()), "feature-increment")
        self._add_values(new, batch_id)
        if self.sums.manifest()["upto"] >= batch_id:           # a replay: merged and compacted before
            merged = self.sums.read().join(new.select(KEY).distinct(), KEY, "left_semi")
        else:
            merged = self._merged(new, batch_id, history)
        merged = stored(merged, "feature-sums")
        self.sums.append(merged, batch_id)
        self.features.append(self._features(merged), batch_id)

    def _add_values(self, new: DataFrame, batch_id: int) -> None:
        amounts = new.where(f"amount IS NOT NULL AND (({CR}) OR ({DR}))").select(
            KEY, F.when(F.expr(CR), F.lit("cr")).otherwise(F.lit("dr")).alias("kind"), F.col("amount").cast("string").alias("item"))
        sources = new.where(f"source IS NOT NULL AND {CR}").select(KEY, F.lit("src").alias("kind"), F.col("source").alias("item"))
        more = amounts.unionByName(sources).groupBy(KEY, "kind", "item").agg(F.count(F.lit(1)).alias("n"))
        old = self.values.read(before=batch_id).withColumnRenamed("n", "_old")
        more = more.join(old, [KEY, "kind", "item"], "left")
        self.values.append(more.withColumn("n", F.col("n") + F.coalesce("_old", F.lit(0))), batch_id)

    def _merged(self, new: DataFrame, batch_id: int, history: DataFrame | None) -> DataFrame:
        """Accumulators of the applicants of ``new``, with it."""
        delta = new.groupBy(KEY).agg(
            *[F.expr(f"CAST(sum({e}) AS {t}) AS {n}") for n, (t, e) in _sums().items()],
            *[F.expr(f"min({e}) AS {n}") for n, (_, e) in _LEAST.items()],
            *[F.expr(f"max({e}) AS {n}") for n, (_, e) in _MOST.items()])
        old = self.sums.read(before=batch_id)
        old = old.select(KEY, *[F.col(c).alias(f"_{c}") for c in old.columns if c != KEY])
        both = stored(delta.join(old, KEY, "left").withColumn("first", F.least("cr_t0", "_cr_t0")), "feature-both")
        moved = both.where(F.col("cr_t0") < F.col("_cr_t0")).select(KEY, "first")
        # days count from the first credit; where that moves, those of the credits before count anew
        again = _days(new.join(both.select(KEY, "first"), KEY)).select(KEY, *_DAYS)
        both = both.join(again, KEY, "left").withColumn("_moved", F.coalesce(F.col("cr_t0") < F.col("_cr_t0"), F.lit(False)))
        if not moved.isEmpty():
            if history is None:
                raise ValueError("the first credit of an applicant moved: the rows before are needed")
            before = _days(history.join(moved, KEY)).select(KEY, *[F.col(c).alias(f"_again_{c}") for c in _DAYS])
            both = both.join(before, KEY, "left")
            for c in _DAYS:
                both = both.withColumn(f"_{c}", F.when(F.col("_moved"), F.col(f"_again_{c}")).otherwise(F.col(f"_{c}")))

        def total(n, t):
            return F.expr(f"CAST(CASE WHEN {n} IS NULL THEN _{n} WHEN _{n} IS NULL THEN {n} ELSE {n} + _{n} END AS {t}) AS {n}")
        return both.select(KEY, *[total(n, t) for n, (t, _) in _sums().items()],
                           *[F.least(n, f"_{n}").alias(n) for n in _LEAST], *[F.greatest(n, f"_{n}").alias(n) for n in _MOST],
                           *[total(n, t) for n, t in _DAYS.items()])

    def _features(self, merged: DataFrame) -> DataFrame:
        """RAW and the features of the applicants in ``merged``."""
        moments = merged.withColumn("cr_sd", F.expr(_deviation("n_cr_amount", "sum_cr", "sq_cr"))) \
                        .withColumn("dr_sd", F.expr(_deviation("n_dr_amount", "sum_dr", "sq_dr")))
        heavy = F.col("n_cr_amount") > HEAVY_KEY_ROWS
        known = merged.select(KEY, F.expr("CAST(n_dr_amount AS DECIMAL(19,0))").alias("m"), "sum_dr", "sq_dr", heavy.alias("heavy"))
        own = self.values.read().join(known, KEY).withColumn("amount", F.when(F.col("kind") != "src", F.col("item")))
        # more than two deviations above the mean, without dividing: equal amounts are none above
        above = "CAST(m * CAST(amount AS DECIMAL(18,2)) - sum_dr AS DOUBLE)"
        spike = f"kind = 'dr' AND m > 1 AND {above} > 0 AND {above} * {above} * CAST(m - 1 AS DOUBLE) > 4.0D * CAST(m AS DOUBLE) * CAST(m * sq_dr - sum_dr * sum_dr AS DOUBLE)"
        counted = own.groupBy(KEY).agg(
            F.expr(f"percentile({_when("kind = 'cr' AND NOT heavy", 'CAST(amount AS DOUBLE)')}, array(0.25D, 0.75D), n) AS cr_q"),
            F.expr("CAST(count_if(kind = 'src') AS INT) AS cr_sources"), F.expr(f"sum({_when(spike, 'n')}) AS n_spike"))
        if not merged.where(heavy).isEmpty():        # too many amounts for one task's buffer
            spread = keyed_exact_quantiles(own.where("kind = 'cr' AND heavy").withColumn("v_", F.col("amount").cast("double")), KEY, "v_",
                                           [0.25, 0.75], ["q1", "q3"], times="n")
            counted = counted.join(spread, KEY, "left").withColumn("cr_q", F.coalesce("cr_q", F.array("q1", "q3"))).drop("q1", "q3")
        n = "CAST(n_cr_amount AS DECIMAL(19,0))"
        across = f"CAST({n} * days2 - days * days AS DOUBLE)"
        slope = _when(f"{across} <> 0.0D", f"CAST({n} * days_cr - days * sum_cr AS DOUBLE) / {across}")
        agg = (moments.join(counted, KEY, "left").withColumn("cr_sources", F.coalesce("cr_sources", F.lit(0)))
               .withColumn("n_spike", F.coalesce("n_spike", F.lit(0).cast("long"))).withColumn("cr_slope", F.expr(slope))
               .withColumn("cr_max", F.col("cr_max").cast("double")).withColumn("cr_min", F.col("cr_min").cast("double")))
        return features_from_aggregates(agg, RAW)

    def read(self) -> DataFrame:
        """RAW and the ledger features of every applicant with ledger rows."""
        return self.features.read()
