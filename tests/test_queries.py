import pytest
from compare import mismatch

from siltbed.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        assert mismatch(spark, SF, QUERIES[name], ORACLES[name]) == ""
    else:
        assert QUERIES[name](spark, SF).count() > 0
