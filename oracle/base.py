"""The fraud tables as SQL over the star schema, and small text helpers."""

from __future__ import annotations


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rnd(x: str, digits: int) -> str:
    """Round half away from zero, after a decimal that absorbs division noise."""
    return f"CAST(ROUND(CAST({x} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def avg(x: str, where: str = "") -> str:
    """Average from an exact sum, optionally over the rows that meet a condition."""
    filtered = f" FILTER (WHERE {where})" if where else ""
    return f"(CAST(SUM({x}){filtered} AS DOUBLE) / NULLIF(COUNT({x}){filtered}, 0))"


def pct(condition: str) -> str:
    """Percent of rows that meet the condition, among all rows."""
    return f"(100.0::DOUBLE * COUNT(*) FILTER (WHERE {condition}) / COUNT(*))"


def case(rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {lit(t)}" for c, t in rules) + f" ELSE {lit(default)} END"


_PAD = "LPAD(CAST({n} AS VARCHAR), CAST(GREATEST({w}, LENGTH(CAST({n} AS VARCHAR))) AS INT), '0')"


def acc(n: str) -> str:
    return "'ACC' || " + _PAD.format(n=n, w=7)


def ring(n: str) -> str:
    return "'RING' || " + _PAD.format(n=n, w=4)


_FRAUD = "k % 29 < (CASE WHEN s < 21600 THEN 3 ELSE 1 END)"

TABLES = {
    "fx_base": """
        SELECT l.*, o_custkey, p_type,
          (l_orderkey*31 + l_partkey*17 + l_linenumber*7919) % 86400 AS s,
          l_orderkey*131 + l_partkey*71 + l_suppkey*13 + l_linenumber AS k
        FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "transactions": f"""
        SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS transaction_id,
          {acc('o_custkey')} AS account_id,
          l_shipdate + s * INTERVAL '1' SECOND AS ts,
          CAST((s - s % 3600) / 3600 AS INT) AS hour_of_day,
          CAST(ISODOW(l_shipdate) - 1 AS INT) AS day_of_week,
          ISODOW(l_shipdate) - 1 >= 5 AS is_weekend,
          CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
          p_type AS merchant_category,
          CAST(l_suppkey % 25 AS VARCHAR) AS merchant_country,
          k % 4 <> 0 AS card_present,
          l_returnflag AS device_type,
          k % 7 < 4 AS device_known,
          CAST(((k * 37) % 1000) / 10.0 AS DECIMAL(6,2)) AS ip_risk_score,
          k % 3 = 0 AS is_foreign_txn,
          CAST(k % 11 AS INT) AS velocity_1h,
          CAST(l_quantity / 10 AS DECIMAL(10,4)) AS amount_vs_avg_ratio,
          k % 5 < 3 AS has_2fa,
          {_FRAUD} AS is_fraud,
          CASE WHEN {_FRAUD} THEN 'pattern_' || (l_partkey % 7) END AS fraud_pattern
        FROM fx_base""",
    "fx_account_agg": """
        SELECT account_id, COUNT(*) AS n, SUM(amount) AS amt, MAX(amount) AS mx,
          COUNT(*) FILTER (WHERE is_fraud) AS nf,
          COALESCE(SUM(amount) FILTER (WHERE is_fraud), 0) AS amtf,
          COUNT(*) FILTER (WHERE is_foreign_txn) AS nfor,
          SUM(velocity_1h) AS vel, SUM(ip_risk_score) AS ip,
          COUNT(DISTINCT merchant_country) AS nc, COUNT(DISTINCT merchant_category) AS ncat
        FROM transactions GROUP BY account_id""",
    "account_profiles": f"""
        SELECT {acc('c_custkey')} AS account_id,
          CAST((c_custkey*37) % 1500 AS INT) AS account_age_days,
          CAST(ABS(c_acctbal) + 1000 AS DECIMAL(12,2)) AS credit_limit,
          CAST(c_nationkey AS VARCHAR) AS home_country,
          CAST(((c_custkey*53) % 600) / 10.0 AS DECIMAL(6,2)) AS risk_score,
          CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS has_2fa,
          c_mktsegment AS account_type,
          {rnd(div('amt', 'n'), 2)} AS avg_txn_amount,
          {rnd(div('n', '82'), 2)} AS avg_monthly_txns,
          n AS total_transactions, amt AS total_amount, mx AS max_amount, nf AS fraud_count, amtf AS fraud_amount,
          {rnd(div('nfor', 'n'), 4)} AS pct_foreign,
          {rnd(div('vel', 'n'), 4)} AS avg_velocity,
          nc AS unique_countries, ncat AS unique_categories,
          {rnd(div('ip', 'n'), 2)} AS avg_ip_risk,
          CASE WHEN nf > 2 THEN 1 ELSE 0 END AS is_fraudster
        FROM customer LEFT JOIN fx_account_agg g ON g.account_id = {acc('c_custkey')}""",
    "network_edges": f"""
        SELECT {acc('a')} AS account_a, {acc('b')} AS account_b,
          CASE a % 3 WHEN 0 THEN 'device' WHEN 1 THEN 'ip' ELSE 'address' END AS shared_type,
          CAST(1 + a % 5 AS INT) AS connection_count,
          {ring('CAST((a - a % 10) / 10 AS BIGINT)')} AS ring_id,
          COALESCE(ga.nf, 0) > 0 AND COALESCE(gb.nf, 0) > 0 AS both_fraud
        FROM (SELECT c_custkey AS a, c_custkey + step AS b FROM customer, (VALUES (1), (2)) v(step)) q
        LEFT JOIN fx_account_agg ga ON ga.account_id = {acc('a')}
        LEFT JOIN fx_account_agg gb ON gb.account_id = {acc('b')}
        WHERE a - a % 10 = b - b % 10""",
}
_NEEDS = {
    "transactions": ["fx_base"],
    "fx_account_agg": ["transactions"],
    "account_profiles": ["fx_account_agg"],
    "network_edges": ["fx_account_agg"],
}


def over(query: str, *ctes: tuple[str, str]) -> str:
    """``query`` preceded by the named CTEs and by those fraud tables that any of them mentions."""
    text = " ".join([query, *[body for _, body in ctes]])
    wanted: list[str] = []

    def want(table: str) -> None:
        for needed in _NEEDS.get(table, []):
            want(needed)
        if table not in wanted:
            wanted.append(table)

    for table in TABLES:
        if table in text:
            want(table)
    parts = [(t, TABLES[t]) for t in wanted] + list(ctes)
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in parts) + "\n" + query if parts else query
