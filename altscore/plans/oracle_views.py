"""DuckDB SQL for the canonical views (FIXTURES.md §2), used by the oracles.

Each constant is the body of one CTE over the raw driver tables, which the
correctness driver registers as views.  ``cte(...)`` joins the ones a query
needs into a ``WITH`` prefix.
"""

from __future__ import annotations

CREDIT_SOURCE = """CASE {k} % 6 WHEN 0 THEN 'UPI' WHEN 1 THEN 'Bank Transfer' WHEN 2 THEN 'Mandi Sale'
  WHEN 3 THEN 'Customer Payment' WHEN 4 THEN 'Government Subsidy' ELSE 'Rent Income' END"""
DEBIT_SOURCE = """CASE {k} % 8 WHEN 0 THEN 'Electricity Bill' WHEN 1 THEN 'Mobile Recharge' WHEN 2 THEN 'Grocery'
  WHEN 3 THEN 'Medical' WHEN 4 THEN 'Fuel' WHEN 5 THEN 'School Fees' WHEN 6 THEN 'Loan EMI'
  ELSE 'Insurance' END"""

VIEWS = {
    "ledger": f"""
SELECT o_custkey AS applicant_id, CAST(o_orderdate AS TIMESTAMP) AS ts, 'credit' AS txn_type,
       CAST(o_totalprice AS DECIMAL(18,2)) AS amount, {CREDIT_SOURCE.format(k='o_orderkey')} AS source,
       CASE WHEN o_orderkey % 9 = 0 THEN 'Credit card refund'
            WHEN o_orderkey % 17 = 0 THEN 'Transfer REJECTED' ELSE 'Credited to account' END AS message,
       'income' AS category
FROM orders
UNION ALL
SELECT o_custkey, CAST(l_shipdate AS TIMESTAMP), 'debit', CAST(l_extendedprice AS DECIMAL(18,2)),
       {DEBIT_SOURCE.format(k='l_partkey')},
       CASE WHEN l_partkey % 13 = 0 THEN 'Card payment' WHEN l_partkey % 11 = 0 THEN 'Payment Failed'
            ELSE 'Debited from account' END,
       'expense'
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "ledger_events": f"""
SELECT user_id AS applicant_id, CAST(ts AS TIMESTAMP) AS ts,
       CASE WHEN event_type IN ('purchase','signup') THEN 'credit' ELSE 'debit' END AS txn_type,
       CAST(value AS DECIMAL(18,2)) AS amount,
       CASE WHEN event_type IN ('purchase','signup') THEN {CREDIT_SOURCE.format(k='k')}
            ELSE {DEBIT_SOURCE.format(k='k')} END AS source,
       CASE event_type WHEN 'error' THEN 'Transaction FAILED' WHEN 'view' THEN 'Credit card payment'
            WHEN 'signup' THEN 'Card payment refund' ELSE 'Ok' END AS message,
       CASE WHEN event_type IN ('purchase','signup') THEN 'income' ELSE 'expense' END AS category
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
    "applicants": """
SELECT c_custkey AS applicant_id,
  CAST(CASE c_custkey % 4 WHEN 0 THEN 200 + (c_custkey*37) % 301 WHEN 1 THEN 100 + (c_custkey*37) % 101
       WHEN 2 THEN 50 + (c_custkey*37) % 51 ELSE (c_custkey % 8 - 3) * 175 END AS INT) AS total_contacts,
  CAST(5 + (c_custkey*13) % 46 AS INT) AS family_contacts,
  CAST(5 + (c_custkey*17) % 76 AS INT) AS business_contacts,
  CAST((c_custkey*7) % 11 AS INT) AS government_contacts,
  ((c_custkey*29) % 7501 + 500) / 100.0::DOUBLE AS avg_communication_frequency,
  CAST((c_custkey*11) % 61 AS INT) AS unique_locations_count,
  ((c_custkey*23) % 20001) / 100.0::DOUBLE AS average_distance_from_home,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE ((c_custkey*41) % 60001) / 100.0::DOUBLE END AS max_distance_from_home,
  CASE c_custkey % 3 WHEN 0 THEN 'Urban' WHEN 1 THEN 'rural' ELSE 'urban' END AS area_type,
  c_custkey % 5 = 0 AS gambling_app_usage,
  CAST((c_custkey*19) % 31 AS INT) AS frequent_location_changes,
  ((c_custkey*31) % 61) / 100.0::DOUBLE AS night_transaction_ratio,
  ((c_custkey*43) % 91 + 10) / 10.0::DOUBLE AS financial_app_usage_score
FROM customer""",
    "users": """
SELECT c_custkey AS user_id, c_name AS full_name, c_acctbal AS monthly_income,
       c_mktsegment AS employment_type, c_nationkey AS nation_id
FROM customer""",
    "applications": """
SELECT o_orderkey AS application_id, o_custkey AS user_id, o_totalprice AS loan_amount,
       CAST(o_orderdate AS TIMESTAMP) AS submitted_at,
       CASE o_orderstatus WHEN 'O' THEN 'submitted' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status,
       o_orderpriority AS loan_purpose
FROM orders""",
    "predictions": """
SELECT event_id AS prediction_id, event_id % (SELECT count(*) FROM orders) AS application_id, k / 100.0::DOUBLE AS score,
       0.3::DOUBLE + (event_id % 66) / 100.0::DOUBLE AS confidence,
       CASE WHEN k / 100.0::DOUBLE > 0.6::DOUBLE THEN 'approve' ELSE 'reject' END AS decision,
       ts AS prediction_timestamp, value AS latency_ms
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
    "audit_logs": """
SELECT event_id AS audit_id, event_id % (SELECT count(*) FROM orders) AS application_id, user_id AS actor_id, event_type,
       props AS event_data, ts AS created_at
FROM events""",
    "request_log": """
SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS client, ts, 'POST' AS method,
       concat('/api/v1/', event_type) AS endpoint, value AS latency_ms,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
       k % 3 = 0 AS cache_hit, k / 100.0::DOUBLE AS score,
       CASE WHEN k % 4 = 0 THEN concat(' 10.0.0.', CAST(user_id AS STRING), ' , 172.16.0.1') END AS x_forwarded_for,
       CASE WHEN k % 4 = 1 THEN concat('192.168.1.', CAST(user_id AS STRING)) END AS x_real_ip,
       CASE WHEN k % 4 = 2 THEN concat('host-', CAST(user_id AS STRING)) END AS client_host
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
    "eval_pairs": """
SELECT prediction_id AS id, ((prediction_id * 7) % 100) / 100.0::DOUBLE AS y_true, score AS y_pred
FROM predictions""",
}


def _application_base_sql() -> str:
    from ..functions.rules import TRANSACTION_RULES
    ok = " AND ".join(f"coalesce({r}, false)" for r in TRANSACTION_RULES.values())
    return f"""orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN applicants a ON o.o_custkey = a.applicant_id
LEFT JOIN (SELECT applicant_id AS t_id, count(*) AS n_txns, count(*) FILTER (WHERE NOT ({ok})) AS n_bad
           FROM ledger GROUP BY applicant_id) t ON o.o_custkey = t.t_id"""


def _app_views():
    from ..sources.views import API_REQUEST_EXPRS, LOAN_APPLICATION_EXPRS
    fix = lambda e: e.replace("AS STRING)", "AS VARCHAR)")
    VIEWS["loan_applications"] = ("SELECT " + ",\n  ".join(fix(e) for e in LOAN_APPLICATION_EXPRS) +
                                  "\nFROM " + _application_base_sql())
    VIEWS["api_requests"] = ("SELECT " + ",\n  ".join(fix(e) for e in API_REQUEST_EXPRS) +
                             "\nFROM " + _application_base_sql())


_app_views()

# Views that read other views (must come after their inputs in a WITH list).
DEPENDS = {"eval_pairs": ["predictions"],
           "loan_applications": ["ledger", "applicants"],
           "api_requests": ["ledger", "applicants"]}


def cte(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` prefix holding the named views (and their inputs) plus extras."""
    order: list[str] = []

    def add(n):
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({VIEWS[n]}\n)" for n in order]
    parts += [f"{n} AS ({body}\n)" for n, body in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""


def half_even(sql: str) -> str:
    """Rewrite every ``round(expr, n)`` into ``round_even(expr * 10^n, 0) / 10^n``.

    Mirrors :func:`altscore.functions.expr.rnd` so that both engines round the
    same IEEE product half-to-even.  ``round(expr)`` without digits is kept.
    """
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 1, j + 6, -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner_end = k - 1
        out.append(sql[i:j])
        if comma < 0:
            out.append(sql[j:k])
        else:
            expr = half_even(sql[j + 6:comma])
            n = int(sql[comma + 1:inner_end].strip())
            s = f"{float(10 ** n)!r}::DOUBLE"
            out.append(f"(round_even(({expr}) * {s}, 0) / {s})")
        i = k
