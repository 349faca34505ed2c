import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import DATA, compare, connection  # noqa: E402

from wayfold.llm import queries  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, connection(), queries.QUERIES[name], queries.ORACLES[name])


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 11))
