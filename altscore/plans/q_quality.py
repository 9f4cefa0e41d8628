"""§2.3 validation and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import quality as Q
from ..sources import views as V
from ..sources.tables import load
from .oracle_views import cte
from .q_portfolio import CACHE_BODY, _rollup_sql, table
from .registry import register

# FIXED VALUES: column length limits of the stored tables.
USER_LENGTHS = {"full_name": 255, "employment_type": 50}
APPLICATION_LENGTHS = {"loan_purpose": 255, "status": 50}


def _violations_sql(rules: dict) -> str:
    items = ", ".join(f"CASE WHEN NOT coalesce({sql}, false) THEN '{name}' END" for name, sql in rules.items())
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def _validate_sql(view: str, rules: dict, key: str) -> str:
    return cte(view) + f"""
SELECT {key}, len(v) = 0 AS is_valid, len(v)::BIGINT AS n_violations, array_to_string(v, '; ') AS message
FROM (SELECT {key}, {_violations_sql(rules)} AS v FROM {view})"""


def _validated_apps(spark, sf_dir):
    return Q.validate(V.loan_applications(spark, sf_dir), R.ALL_APPLICATION_RULES, "application_id")


@register("validate_applications", _validate_sql("loan_applications", R.ALL_APPLICATION_RULES, "application_id"))
def q_validate_applications(spark, sf_dir):
    """V2-V6 + V9: every rule of an application, one pass."""
    return _validated_apps(spark, sf_dir)


@register("validate_api_request", _validate_sql("api_requests", R.API_RULES, "application_id"))
def q_validate_api_request(spark, sf_dir):
    """V7: API request limits."""
    return Q.validate(V.api_requests(spark, sf_dir), R.API_RULES, "application_id")


def _counts_sql(view: str, rules: dict) -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE NOT coalesce({sql}, false)) AS {name}" for name, sql in rules.items())
    names = ", ".join(rules)
    return cte(view) + f"""
SELECT rule, n_failed FROM (UNPIVOT (SELECT {cols} FROM {view}) ON {names} INTO NAME rule VALUE n_failed)"""


@register("validate_transactions", _counts_sql("ledger", R.TRANSACTION_RULES))
def q_validate_transactions(spark, sf_dir):
    """V1: failures per transaction rule over the whole ledger."""
    return Q.violation_counts(V.ledger(spark, sf_dir), R.TRANSACTION_RULES)


@register("violation_counts", _counts_sql("loan_applications", R.ALL_APPLICATION_RULES))
def q_violation_counts(spark, sf_dir):
    """Failures per application rule."""
    return Q.violation_counts(V.loan_applications(spark, sf_dir), R.ALL_APPLICATION_RULES)


_VALIDATED_CTE = ("va", f"""SELECT application_id, user_id, len(v) = 0 AS is_valid, array_to_string(v, '; ') AS message
FROM (SELECT application_id, user_id, {_violations_sql(R.ALL_APPLICATION_RULES)} AS v FROM loan_applications)""")

QUALITY_SQL = cte("loan_applications", extra=[_VALIDATED_CTE]) + """
SELECT count(*) AS total_records, count(*) FILTER (WHERE is_valid) AS valid_records,
       count(*) FILTER (WHERE NOT is_valid) AS invalid_records,
       CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE is_valid) / count(*) * 100.0::DOUBLE END AS quality_score
FROM va"""


@register("quality_metrics", QUALITY_SQL)
def q_quality_metrics(spark, sf_dir):
    """Full-pass totals and quality score."""
    return Q.quality_metrics(_validated_apps(spark, sf_dir))


SAMPLE_SQL = cte("loan_applications", extra=[_VALIDATED_CTE]) + """
SELECT * FROM (SELECT application_id, concat('Row ', CAST(application_id AS VARCHAR), ': ', message) AS message
               FROM va WHERE NOT is_valid ORDER BY application_id LIMIT 100)
UNION ALL
SELECT NULL, '... (additional errors truncated)' WHERE (SELECT count(*) FROM va WHERE NOT is_valid) >= 100"""


@register("violation_sample", SAMPLE_SQL)
def q_violation_sample(spark, sf_dir):
    """First 100 error messages (the limit is the feature)."""
    return Q.violation_sample(_validated_apps(spark, sf_dir), "application_id", 100)


CLEAN_SQL = cte("loan_applications", extra=[_VALIDATED_CTE]) + """
SELECT application_id, user_id FROM va WHERE is_valid"""


@register("clean_invalid", CLEAN_SQL)
def q_clean_invalid(spark, sf_dir):
    """Valid applications only."""
    return Q.clean_invalid(V.loan_applications(spark, sf_dir), R.ALL_APPLICATION_RULES).select(
        "application_id", "user_id")


_APP_COLS = ["application_id", "user_id", "age", "gender", "occupation", "monthly_income",
             "loan_amount_requested", "loan_purpose", "profitability_score", "latitude", "longitude"]

NULLS_SQL = cte("loan_applications") + f"""
SELECT column_name, n_null FROM (UNPIVOT (SELECT {", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in _APP_COLS)}
  FROM loan_applications) ON {", ".join(_APP_COLS)} INTO NAME column_name VALUE n_null)"""


@register("null_counts", NULLS_SQL)
def q_null_counts(spark, sf_dir):
    """Nulls per column."""
    return Q.null_counts(V.loan_applications(spark, sf_dir), _APP_COLS)


BATCH_SQL = cte("loan_applications") + """
SELECT user_id AS batch_id, count(*) AS n_applications, count(*) BETWEEN 1 AND 100 AS valid_batch
FROM loan_applications GROUP BY user_id"""


@register("validate_batch_size", BATCH_SQL)
def q_validate_batch_size(spark, sf_dir):
    """V8: 1..100 applications per batch (a batch = one user's applications)."""
    a = V.loan_applications(spark, sf_dir)
    return (a.groupBy(F.col("user_id").alias("batch_id")).agg(F.count(F.lit(1)).alias("n_applications"))
            .withColumn("valid_batch", F.col("n_applications").between(1, 100)))


UNIQUE_SQL = """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""


@register("check_unique", UNIQUE_SQL)
def q_check_unique(spark, sf_dir):
    """Duplicate (order, line number) pairs."""
    li = load(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"])
    return Q.duplicate_keys(li, ["l_orderkey", "l_linenumber"])


_IDS = {"users": "user_id", "applications": "application_id", "predictions": "prediction_id"}
UNIQUE_ID_SQL = cte(*_IDS) + "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_duplicated FROM "
    f"(SELECT {c} FROM {t} GROUP BY {c} HAVING count(*) > 1)" for t, c in _IDS.items())


@register("check_unique_ids", UNIQUE_ID_SQL)
def q_check_unique_ids(spark, sf_dir):
    """Ids of users, applications and predictions that occur more than once."""
    out = None
    for t, c in _IDS.items():
        part = Q.duplicate_counts(getattr(V, t)(spark, sf_dir), [c]).select(F.lit(t).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


FK_SQL = cte("applications", "users", "predictions", "audit_logs") + """
SELECT 'applications->users' AS relation, count(*) AS n_orphans FROM applications a
  WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.user_id = a.user_id)
UNION ALL
SELECT 'predictions->applications', count(*) FROM predictions p
  WHERE NOT EXISTS (SELECT 1 FROM applications a WHERE a.application_id = p.application_id)
UNION ALL
SELECT 'audit_logs->applications', count(*) FROM audit_logs l
  WHERE l.application_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM applications a WHERE a.application_id = l.application_id)"""


@register("check_foreign_keys", FK_SQL)
def q_check_foreign_keys(spark, sf_dir):
    """Orphan counts per relation (anti joins)."""
    apps, users = V.applications(spark, sf_dir), V.users(spark, sf_dir)
    preds, audit = V.predictions(spark, sf_dir), V.audit_logs(spark, sf_dir)

    def count(df, name):
        return df.agg(F.count(F.lit(1)).alias("n_orphans")).select(F.lit(name).alias("relation"), "n_orphans")

    return (count(Q.orphans(apps, users, "user_id", "user_id"), "applications->users")
            .unionByName(count(Q.orphans(preds, apps, "application_id", "application_id"),
                               "predictions->applications"))
            .unionByName(count(Q.orphans(audit, apps, "application_id", "application_id", nullable=True),
                               "audit_logs->applications")))


_NN = {"applications": ["application_id", "user_id", "loan_amount", "loan_purpose", "status", "submitted_at"],
       "users": ["user_id"], "predictions": ["prediction_id", "application_id", "score", "confidence", "decision",
                                             "prediction_timestamp"],
       "audit_logs": ["audit_id", "event_type", "created_at"], "model_metrics": ["period_start", "period_end"],
       "cache_metrics": ["timestamp"]}
_METRICS = [("model_metrics", "\nUNION ALL\n".join(_rollup_sql(p) for p in R.PERIOD_VALUES)), ("cache_metrics", CACHE_BODY)]

NOT_NULL_SQL = cte("applications", "users", "predictions", "audit_logs", "request_log", extra=_METRICS) + "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, column_name, n_null FROM (UNPIVOT (SELECT "
    + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in cols)
    + f" FROM {t}) ON {', '.join(cols)} INTO NAME column_name VALUE n_null)"
    for t, cols in _NN.items())


@register("check_not_null", NOT_NULL_SQL)
def q_check_not_null(spark, sf_dir):
    """NULLs in NOT NULL columns."""
    out = None
    for t, cols in _NN.items():
        part = Q.null_counts(table(spark, sf_dir, t), cols).select(F.lit(t).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


# FIXED VALUES: limits of the other tables' columns.
OTHER_LENGTHS = [("predictions", "decision", 50), ("audit_logs", "event_type", 100), ("model_metrics", "period_type", 20)]
LENGTH_SQL = cte("users", "applications", "predictions", "audit_logs", "request_log", extra=_METRICS) + "\nUNION ALL\n".join(
    [f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE length({c}) > {n}) AS n_too_long FROM users"
     for c, n in USER_LENGTHS.items()] +
    [f"SELECT '{c}', count(*) FILTER (WHERE length({c}) > {n}) FROM applications"
     for c, n in APPLICATION_LENGTHS.items()] +
    [f"SELECT '{c}', count(*) FILTER (WHERE length({c}) > {n}) FROM {t}" for t, c, n in OTHER_LENGTHS])


@register("check_string_length", LENGTH_SQL)
def q_check_string_length(spark, sf_dir):
    """Values over the column length limits."""
    out = Q.too_long(V.users(spark, sf_dir), USER_LENGTHS).unionByName(
        Q.too_long(V.applications(spark, sf_dir), APPLICATION_LENGTHS))
    for t, c, n in OTHER_LENGTHS:
        out = out.unionByName(Q.too_long(table(spark, sf_dir, t), {c: n}))
    return out


def _in_list(vals):
    return "(" + ", ".join(f"'{v}'" for v in vals) + ")"


ENUM_SQL = cte("applications", "predictions", "request_log", extra=_METRICS) + f"""
SELECT 'period_type' AS column_name, count(*) FILTER (WHERE period_type IS NOT NULL AND period_type NOT IN {_in_list(R.PERIOD_VALUES)}) AS n_invalid FROM model_metrics
UNION ALL
SELECT 'status' AS column_name, count(*) FILTER (WHERE status IS NOT NULL AND status NOT IN {_in_list(R.STATUS_VALUES)}) AS n_invalid FROM applications
UNION ALL
SELECT 'decision', count(*) FILTER (WHERE decision IS NOT NULL AND decision NOT IN {_in_list(R.DECISION_VALUES)}) FROM predictions"""


@register("check_status_enum", ENUM_SQL)
def q_check_status_enum(spark, sf_dir):
    """Enumerated columns."""
    return Q.bad_enum(V.applications(spark, sf_dir), {"status": R.STATUS_VALUES}).unionByName(
        Q.bad_enum(V.predictions(spark, sf_dir), {"decision": R.DECISION_VALUES})).unionByName(
        Q.bad_enum(table(spark, sf_dir, "model_metrics"), {"period_type": R.PERIOD_VALUES}))


# Line-item columns with the driver's Parquet types (Spark simple names).
_LINEITEM_TYPES = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                   ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                   ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                   ("l_linestatus", "string")]


def _profile_sql() -> str:
    parts = []
    for c, t in _LINEITEM_TYPES:
        if t in ("bigint", "int"):
            parts.append(f"""SELECT '{c}' AS column_name, '{t}' AS source_type,
  CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint'
       WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint'
       WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS narrow_type,
  NULL::BOOLEAN AS low_cardinality FROM lineitem""")
        elif t == "double":
            parts.append(f"SELECT '{c}', '{t}', 'float', NULL::BOOLEAN")
        else:
            share = f"count(DISTINCT {c}) / greatest(count(*), 1)"
            parts.append(f"SELECT '{c}', 'string', CASE WHEN {share} < 0.5 THEN 'category' ELSE 'string' END, "
                         f"{share} < 0.5 FROM lineitem")
    return "\nUNION ALL\n".join(parts)


@register("profile_narrow_types", _profile_sql())
def q_profile_narrow_types(spark, sf_dir):
    """Narrowest type per column of the line items."""
    return Q.narrow_type_profile(load(spark, sf_dir, "lineitem"))


@register("narrow_types_applied", """
SELECT count(*) AS n, sum(l_orderkey)::BIGINT AS orderkeys, sum(l_suppkey)::BIGINT AS suppkeys, sum(l_linenumber)::BIGINT AS linenumbers,
       sum(CAST(l_quantity AS FLOAT)::DOUBLE) AS quantity, max(l_returnflag) AS flag
FROM lineitem""")
def q_narrow_types_applied(spark, sf_dir):
    """The casts themselves; no integer changes, doubles become floats."""
    li = load(spark, sf_dir, "lineitem")
    n = Q.narrowed(li, Q.narrow_type_profile(li))
    return n.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_orderkey").cast("long")).alias("orderkeys"),
                 F.sum(F.col("l_suppkey").cast("long")).alias("suppkeys"),
                 F.sum(F.col("l_linenumber").cast("long")).alias("linenumbers"),
                 F.sum(F.col("l_quantity").cast("double")).alias("quantity"), F.max("l_returnflag").alias("flag"))
