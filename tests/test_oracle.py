"""Registered queries against their SQL. A sample runs by default; set ALL_QUERIES=1 for every query."""

import os

import pytest
from check_oracle import compare, connect

from tidebars.plans.catalog import catalog

FOLDER = "/root/testdata/sf0.001"
SAMPLE = "a5_candle_documents a6_request_ranges a10_config_documents b2_fill_forward c1_common_dates d4_sharpe d15_month_matrix d17_describe_features e4_ewma_vol e10_adx e19_regime_hysteresis e21_kalman_adaptive f1_equity f2_stopped_equity f3_joint_ledger f17_trade_log f18_order_sizing f20_action_ledger g1_bootstrap_sharpe g3_superior_ability h4_nearest_expiry k2_stream_bars".split()
NAMES = list(catalog()) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    fn, sql = catalog()[name]
    ok, note, _, _ = compare(spark, con, name, fn, sql, FOLDER)
    assert ok, note


def test_names_are_complete():
    have = {n.split("_")[0] for n in catalog()}
    want = (
        [f"a{k}" for k in (1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 16)] + [f"b{k}" for k in (*range(1, 13), 14)] + [f"c{k}" for k in range(1, 10)]
        + [f"d{k}" for k in range(1, 27)] + [f"e{k}" for k in range(1, 35)] + [f"f{k}" for k in range(1, 22)] + [f"g{k}" for k in range(1, 6)]
        + [f"h{k}" for k in range(1, 7)] + [f"k{k}" for k in range(1, 9)]
    )
    assert not sorted(set(want) - have)
