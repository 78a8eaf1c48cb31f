"""The fraud tables, derived from a star schema of orders.

Lets every investigation run on whole tables of customers, orders and line
items. All flags come from integer arithmetic on the keys, so another engine
can derive the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators.filters import share_of
from tamarack.plans.derived import account_totals, hourly_rollup, pattern_profile, pattern_stats
from tamarack.session import stored_in_turn

#: parts in which large intermediate results are made, one after another
SHARES = 4


def _padded(prefix: str, number: str, width: int) -> str:
    text = f"CAST({number} AS STRING)"
    return f"'{prefix}' || lpad({text}, greatest({width}, length({text})), '0')"


def _rounded_ratio(part: str, whole: str, digits: int) -> str:
    ratio = f"CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0D)"
    return f"CAST(round(CAST({ratio} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


_FRAUD = "k % 29 < CASE WHEN s < 21600 THEN 3 ELSE 1 END"


def _derived(lines: DataFrame) -> DataFrame:
    return lines.selectExpr(
        "*",
        "(l_orderkey*31 + l_partkey*17 + l_linenumber*7919) % 86400 AS s",
        "l_orderkey*131 + l_partkey*71 + l_suppkey*13 + l_linenumber AS k",
    ).selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS transaction_id",
        f"{_padded('ACC', 'o_custkey', 7)} AS account_id",
        "l_shipdate + s * INTERVAL '1' SECOND AS ts",
        "CAST((s - s % 3600) / 3600 AS INT) AS hour_of_day",
        "weekday(l_shipdate) AS day_of_week",
        "weekday(l_shipdate) >= 5 AS is_weekend",
        "CAST(l_extendedprice AS DECIMAL(12,2)) AS amount",
        "p_type AS merchant_category",
        "CAST(l_suppkey % 25 AS STRING) AS merchant_country",
        "k % 4 <> 0 AS card_present",
        "l_returnflag AS device_type",
        "k % 7 < 4 AS device_known",
        "CAST(((k * 37) % 1000) / 10.0 AS DECIMAL(6,2)) AS ip_risk_score",
        "k % 3 = 0 AS is_foreign_txn",
        "CAST(k % 11 AS INT) AS velocity_1h",
        "CAST(l_quantity / 10 AS DECIMAL(10,4)) AS amount_vs_avg_ratio",
        "k % 5 < 3 AS has_2fa",
        f"{_FRAUD} AS is_fraud",
        f"CASE WHEN {_FRAUD} THEN 'pattern_' || (l_partkey % 7) END AS fraud_pattern",
    )


class StarTables:
    """Fraud tables over the parquet files of one folder. Nothing is read before it is used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def _read(self, table: str) -> DataFrame:
        if table not in self._tables:
            self._tables[table] = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
        return self._tables[table]

    @cached_property
    def transactions(self) -> DataFrame:
        return _derived(self._joined_lines())

    def _joined_lines(self, share: int = 0, shares: int = 1) -> DataFrame:
        """The line items with their order's customer and their part's type; of one share of the orders."""
        lines = self._read("lineitem")
        # both are fact tables: they meet by a shuffle at every size
        orders = self._read("orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey").hint("merge")
        parts = self._read("part").selectExpr("p_partkey AS l_partkey", "p_type")
        if shares > 1:
            lines, orders = (x.filter(share_of("l_orderkey", shares) == share) for x in (lines, orders))
        return lines.join(orders, "l_orderkey").join(parts, "l_partkey")

    @cached_property
    def _dealt(self) -> DataFrame:
        """The transactions with their account's share."""
        return self.transactions.withColumn("_share", share_of("account_id", SHARES))

    def with_stored_transactions(self) -> StarTables:
        """The same tables, their transactions joined once and read back; for a query of many passes over them.

        One share of the orders is joined at a time, which bounds the disk that the shuffles take. The rows of an
        account lie together, a very large one in several files: a task that sums per account has a row of each to pass on.
        """

        def joined(share: int) -> DataFrame:
            part = StarTables(self.spark, self.folder)
            part.transactions = _derived(self._joined_lines(share, SHARES).hint("rebalance", "o_custkey"))
            return part._dealt

        again = StarTables(self.spark, self.folder)
        again._dealt = stored_in_turn(map(joined, range(SHARES)), "transactions", "_share", compression="zstd")
        again.transactions = again._dealt.drop("_share")
        return again

    def shares_of_accounts(self) -> Iterator[StarTables]:
        """The transactions in parts, those of an account together, to be worked through one at a time."""
        for i in range(SHARES):
            part = StarTables(self.spark, self.folder)
            part.transactions = self._dealt.filter(F.col("_share") == i).drop("_share")
            yield part

    @cached_property
    def lines(self) -> DataFrame:
        """The two-part key of the line items."""
        return self._read("lineitem").selectExpr("concat_ws('-', l_orderkey, l_linenumber) AS line")

    @cached_property
    def accounts(self) -> DataFrame:
        """The part of the account table that does not come from transactions."""
        return self._read("customer").selectExpr(
            f"{_padded('ACC', 'c_custkey', 7)} AS account_id",
            "CAST((c_custkey*37) % 1500 AS INT) AS account_age_days",
            "CAST(abs(c_acctbal) + 1000 AS DECIMAL(12,2)) AS credit_limit",
            "CAST(c_nationkey AS STRING) AS home_country",
            "CAST(((c_custkey*53) % 600) / 10.0 AS DECIMAL(6,2)) AS risk_score",
            "CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS has_2fa",
            "c_mktsegment AS account_type",
        )

    @cached_property
    def accounts_with_fraud(self) -> DataFrame:
        """Accounts with their fraud count only, for readers of nothing else."""
        return self._flagged(self.accounts.join(self._fraud_counts, "account_id", "left"))

    @cached_property
    def _fraud_counts(self) -> DataFrame:
        return self.transactions.filter("is_fraud").groupBy("account_id").agg(F.count("*").alias("nf"))

    @staticmethod
    def _flagged(df: DataFrame) -> DataFrame:
        return df.withColumn("is_fraudster", F.expr("CASE WHEN nf > 2 THEN 1 ELSE 0 END"))

    @cached_property
    def account_profiles(self) -> DataFrame:
        joined = self.accounts.join(account_totals(self.transactions), "account_id", "left")
        return self._flagged(joined).selectExpr(
            *self.accounts.columns,
            f"{_rounded_ratio('amt', 'n', 2)} AS avg_txn_amount",
            f"{_rounded_ratio('n', '82', 2)} AS avg_monthly_txns",
            "n AS total_transactions",
            "amt AS total_amount",
            "mx AS max_amount",
            "nf AS fraud_count",
            "amtf AS fraud_amount",
            f"{_rounded_ratio('nfor', 'n', 4)} AS pct_foreign",
            f"{_rounded_ratio('vel', 'n', 4)} AS avg_velocity",
            "nc AS unique_countries",
            "ncat AS unique_categories",
            f"{_rounded_ratio('ip', 'n', 2)} AS avg_ip_risk",
            "is_fraudster",
        )

    @cached_property
    def network_edges(self) -> DataFrame:
        pairs = (
            self._read("customer")
            .selectExpr("c_custkey AS a", "explode(array(c_custkey + 1, c_custkey + 2)) AS b")
            .filter("a - a % 10 = b - b % 10")
            .selectExpr(
                f"{_padded('ACC', 'a', 7)} AS account_a",
                f"{_padded('ACC', 'b', 7)} AS account_b",
                "CASE a % 3 WHEN 0 THEN 'device' WHEN 1 THEN 'ip' ELSE 'address' END AS shared_type",
                "CAST(1 + a % 5 AS INT) AS connection_count",
                f"{_padded('RING', 'CAST((a - a % 10) / 10 AS BIGINT)', 4)} AS ring_id",
            )
        )
        first = self._fraud_counts.selectExpr("account_id AS account_a", "nf AS nf_a")
        second = self._fraud_counts.selectExpr("account_id AS account_b", "nf AS nf_b")
        return (
            pairs.join(first, "account_a", "left")
            .join(second, "account_b", "left")
            .select(*pairs.columns, F.expr("nf_a IS NOT NULL AND nf_b IS NOT NULL AS both_fraud"))
        )

    @cached_property
    def part_patterns(self) -> DataFrame:
        """The pattern that belongs to each part, whether or not a transaction shows it."""
        return self._read("part").selectExpr("p_partkey", "'pattern_' || (p_partkey % 7) AS fraud_pattern")

    @cached_property
    def fraud_patterns(self) -> DataFrame:
        return pattern_profile(self.transactions)

    @cached_property
    def fraud_pattern_rates(self) -> DataFrame:
        """The pattern table without its median, which the investigations do not read."""
        return pattern_stats(self.transactions)

    @cached_property
    def time_series_stats(self) -> DataFrame:
        return hourly_rollup(self.transactions)
