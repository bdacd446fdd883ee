import pytest

from strandframe.llm.queries import ORACLES, QUERIES
from tools.compare import canonical, views


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = views(sf_dir).execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
