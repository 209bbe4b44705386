"""Every query that has SQL against it."""

import pytest

from checks.compare import difference
from faregrid.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), sf_dir, ORACLES[name]) is None


def test_names():
    assert ORACLES.keys() <= QUERIES.keys()
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op")) == list(range(1, 14))
