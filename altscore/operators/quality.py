"""Validation and data-quality operators.

Every rule is one boolean column; all rules of a record are evaluated in a
single narrow projection and gathered into ``violations: array<string>``.
Summaries are single global aggregates (partial aggregation per task, one
row to the driver-side final stage), so they scale with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rule_ok(sql: str):
    """Predicate column; NULL counts as failed."""
    return F.coalesce(F.expr(sql), F.lit(False))


def with_violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Add ``violations``: names of the failed rules, in rule order."""
    arr = F.array(*[F.when(~rule_ok(sql), F.lit(name)) for name, sql in rules.items()])
    return df.withColumn("violations", F.filter(arr, lambda x: x.isNotNull()))


def validate(df: DataFrame, rules: dict[str, str], key: str, keep=()) -> DataFrame:
    """V9: ``(key, *keep, is_valid, n_violations, message)`` per record."""
    v = with_violations(df, rules)
    return v.select(key, *keep, (F.size("violations") == 0).alias("is_valid"),
                    F.size("violations").cast("bigint").alias("n_violations"),
                    F.array_join("violations", "; ").alias("message"))


def quality_metrics(validated: DataFrame) -> DataFrame:
    """Totals and quality score = valid / total x 100 (0 on empty)."""
    agg = validated.agg(F.count(F.lit(1)).alias("total_records"),
                        F.count_if("is_valid").alias("valid_records"))
    return agg.select(
        "total_records", "valid_records",
        (F.col("total_records") - F.col("valid_records")).alias("invalid_records"),
        F.when(F.col("total_records") == 0, F.lit(0.0))
         .otherwise(F.col("valid_records") / F.col("total_records") * 100.0).alias("quality_score"))


def violation_counts(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Failures per rule (zero counts included), one global aggregate."""
    agg = df.agg(*[F.count_if(~rule_ok(sql)).alias(name) for name, sql in rules.items()])
    return agg.unpivot([], list(rules), "rule", "n_failed")


def null_counts(df: DataFrame, columns=None) -> DataFrame:
    """NULLs per column."""
    cols = list(columns or df.columns)
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return agg.unpivot([], cols, "column_name", "n_null")


TRUNCATION_MARKER = "... (additional errors truncated)"


def violation_sample(validated: DataFrame, key: str, n: int = 100) -> DataFrame:
    """The first ``n`` error messages by key (a top-k, not a full sort),
    ``Row <key>: <violations>``, plus the truncation marker row once ``n``
    errors exist (counts stay full-pass: see ``quality_metrics``)."""
    bad = validated.filter(~F.col("is_valid"))
    top = bad.orderBy(key).limit(n).select(
        key, F.concat(F.lit("Row "), F.col(key).cast("string"), F.lit(": "), F.col("message")).alias("message"))
    key_type = validated.schema[key].dataType
    marker = (bad.agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n)
              .select(F.lit(None).cast(key_type).alias(key), F.lit(TRUNCATION_MARKER).alias("message")))
    return top.unionByName(marker)


def clean_invalid(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Records that pass every rule."""
    ok = None
    for sql in rules.values():
        ok = rule_ok(sql) if ok is None else (ok & rule_ok(sql))
    return df.filter(ok)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str, nullable: bool = False) -> DataFrame:
    """Child rows whose foreign key has no parent (NULL allowed if nullable)."""
    c = child.filter(F.col(fk).isNotNull()) if nullable else child
    return c.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def too_long(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Values longer than the column limit, per column."""
    agg = df.agg(*[F.count_if(F.length(c) > n).alias(c) for c, n in limits.items()])
    return agg.unpivot([], list(limits), "column_name", "n_too_long")


def bad_enum(df: DataFrame, allowed: dict[str, tuple]) -> DataFrame:
    """Values outside the allowed set, per column (NULL is not counted)."""
    agg = df.agg(*[F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(list(v))).alias(c)
                   for c, v in allowed.items()])
    return agg.unpivot([], list(allowed), "column_name", "n_invalid")


def narrow_type_profile(df: DataFrame, columns=None) -> DataFrame:
    """Per numeric column min / max and the narrowest type holding them;
    per string column the distinct share (low-cardinality when < 0.5).

    One aggregate over all columns; distinct values are counted exactly
    (values are deduplicated where they are before they are shuffled).
    """
    from pyspark.sql import types as T
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    aggs = [F.count(F.lit(1)).alias("__n")]
    for f in fields:
        if isinstance(f.dataType, T.NumericType):
            aggs += [F.min(f.name).cast("double").alias(f"{f.name}__min"),
                     F.max(f.name).cast("double").alias(f"{f.name}__max")]
        elif isinstance(f.dataType, T.StringType):
            aggs += [F.count_distinct(f.name).alias(f"{f.name}__nd")]
    row = df.agg(*aggs)
    parts = []
    for f in fields:
        if isinstance(f.dataType, T.IntegralType):
            lo, hi = F.col(f"{f.name}__min"), F.col(f"{f.name}__max")
            narrow = (F.when((lo >= -128) & (hi <= 127), "tinyint")
                      .when((lo >= -32768) & (hi <= 32767), "smallint")
                      .when((lo >= -2147483648) & (hi <= 2147483647), "int").otherwise("bigint"))
            parts.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString())
                                  .alias("source_type"), narrow.alias("narrow_type"),
                                  F.lit(None).cast("boolean").alias("low_cardinality")))
        elif isinstance(f.dataType, T.FractionalType):
            parts.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString())
                                  .alias("source_type"), F.lit("float").alias("narrow_type"),
                                  F.lit(None).cast("boolean").alias("low_cardinality")))
        elif isinstance(f.dataType, T.StringType):
            share = F.col(f"{f.name}__nd") / F.greatest(F.col("__n"), F.lit(1))
            parts.append(F.struct(F.lit(f.name).alias("column_name"), F.lit("string").alias("source_type"),
                                  F.when(share < 0.5, "category").otherwise("string").alias("narrow_type"),
                                  (share < 0.5).alias("low_cardinality")))
    return row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def narrowed(df: DataFrame, profile: DataFrame) -> DataFrame:
    """``df`` with the types of ``narrow_type_profile`` (a row per column);
    low-cardinality strings stay strings, which Parquet stores as dictionaries."""
    types = {r["column_name"]: r["narrow_type"] for r in profile.collect()}
    return df.select(*[F.col(c).cast(types[c]).alias(c) if types.get(c) not in (None, "category", "string") else F.col(c)
                       for c in df.columns])


def duplicate_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column, the values that occur more than once (NULL is no value)."""
    out = None
    for c in columns:
        n = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        part = n.agg(F.count(F.lit(1)).alias("n_duplicated")).select(F.lit(c).alias("column_name"), "n_duplicated")
        out = part if out is None else out.unionByName(part)
    return out
