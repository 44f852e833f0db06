"""Catalogue queries against an independent engine at the smallest scale."""

import pytest
from oracle import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# One query per family here; all of them are checked by run_oracle.py at sf0.01.
NAMES = ["a1_a2_month_rows", "w1_w3_j5_p24_month_bars", "j2_asof_strict", "j1_asof_inclusive_daily", "p25_ratios", "a14_universe_cap_weighted", "a31_performance",
         "l2_l4_fifo_disposals", "l3_rejected_sales", "w21_l11_running_positions", "l12_l14_j14_o3_rebalance_orders", "d4_w17_date_order", "s16_f7_u5_nested_statements", "s16_f7_all_items", "s16_company_info",
         "s6_vendor_b_fundamentals", "t2_stream_month_bars"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == ""


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert "roe" in df.columns and df.count() > 0
