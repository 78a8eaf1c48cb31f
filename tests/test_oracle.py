"""Every query against independent SQL in another engine, on whole tables."""

import pytest

import __spark_entry__ as entry
import checks
from oracle.operators import oracles
from tamarack import registry

QUERIES, SQL = registry.queries(), oracles()


@pytest.fixture(scope="module")
def con(small):
    return checks.connect(small)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, small, name):
    assert checks.compare(spark, con, small, name, QUERIES[name], SQL[name]).startswith("same")


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 7 and abs(sum(r.share_of_fraud_loss for r in rows) - 100) < 0.1


def test_invariants(spark, small):
    """What must hold on any data."""

    def rows(name):
        return QUERIES[name](spark, small).collect()

    for r in rows("q08_response_lag"):
        parts = r.loss_within_5day_response_window + r.loss_after_response_window_missed
        assert abs(parts - r.preventable_loss_usd) < 0.005
    spread = {r.ring_id: r for r in rows("q05_ring_contagion")}
    for r in rows("q08_response_lag"):
        assert spread[r.ring_id].seed_account == r.seed_account
        assert r.downstream_accounts_activated <= spread[r.ring_id].connected_accounts
    segments = rows("q06_cross_subsidy")
    assert abs(sum(r.share_of_total_fraud_loss for r in segments) - 100) < 0.1
    patterns = rows("q01_resource_efficiency")
    assert sum(r.total_fraud_txns for r in patterns) == sum(r.fraud_txns for r in segments)
    assert abs(sum(r.resource_efficiency_gap for r in patterns)) < 0.1
    cells = rows("res_heatmap")
    assert len(cells) == 168 and sum(c.fraud for c in cells) == sum(r.fraud_txns for r in segments)
