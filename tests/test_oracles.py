"""Every registered query: against its SQL where it has one, else that it gives rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402
from tallyframe.plans.catalog import ORACLES, QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"
# Whole studies: a minute or two each. TEST_SLOW=1 runs them.
SLOW = {"B10_run_backtest", "B11_compare_models", "B12_ablate_priors", "B13_sensitivity_grid", "B13_robustness_records"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SLOW and not os.environ.get("TEST_SLOW"):
        pytest.skip("slow job, run with TEST_SLOW=1")
    df = QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    cur = check.duck(DATA).execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    message = check.compare(check.rows_of(df.columns, rows), check.rows_of(names, cur.fetchall()))
    assert message is None, message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
