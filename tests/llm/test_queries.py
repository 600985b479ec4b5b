import os

import pytest

from docketry.llm.queries import LLM
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(LLM.oracle))
def test_same_as_sql(spark, name):
    oracle.assert_same(LLM.queries[name](spark, oracle.FOLDER), oracle.connection().execute(LLM.oracle[name]))


@pytest.mark.parametrize("name", sorted(set(LLM.queries) - set(LLM.oracle)))
def test_runs(spark, name):
    LLM.queries[name](spark, oracle.FOLDER).collect()


def test_splits_keep_groups_and_shares(spark):
    rows = LLM.queries["p3_splits"](spark, "/root/testdata/sf0.01").collect() if os.path.isdir("/root/testdata/sf0.01") else []
    if rows:
        assert len({r.group_id for r in rows}) == len({(r.group_id, r.split) for r in rows})
        train = sum(r.split == "train" for r in rows) / len(rows)
        assert 0.7 < train < 0.9
