"""Every registered query against its SQL on the smallest tables, and what its plan may hold."""

import os

import pytest

import __spark_entry__ as contract
import checks.registry
from checks.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
PYTHON_ALLOWED = {"label_correlation", "study_correlations"}    # the one-row p-value
HASHED = {"link_positions", "first_fifty_links", "distinct_page_links", "first_row_per_key"}    # combined, not sorted

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


# Those of folders that may be absent are tested there.
NAMES = sorted(name for name, made in contract.queries().items() if made.__module__.startswith(checks.__name__ + "."))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name):
    made = []

    def build(session, sf_dir):
        made.append(contract.queries()[name](session, sf_dir))
        return made[0]

    rows, problem = difference(spark, tables, SF_DIR, build, contract.oracle_sql().get(name))
    assert problem is None
    assert rows > 0 or name in {"forum_submissions_with_brand"}
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan
    assert "ArrowEvalPython" not in plan or name in PYTHON_ALLOWED
    assert "SortAggregate" not in plan or name not in HASHED


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns[0] == "brand_category" and rows.count() == 3


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
