import os

import pytest

from docketry.plans import load
from docketry.registry import CORE
from tests import oracle

load()
pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(CORE.oracle))
def test_same_as_sql(spark, con, name):
    oracle.assert_same(CORE.queries[name](spark, oracle.FOLDER), con.execute(CORE.oracle[name]))


@pytest.mark.parametrize("name", sorted(set(CORE.queries) - set(CORE.oracle)))
def test_runs(spark, name):
    CORE.queries[name](spark, oracle.FOLDER).collect()
