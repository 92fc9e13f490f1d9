import pytest
from junctura.plans import checks, filled, grading, placements, reports, scoring, sequences  # noqa: F401  add their queries
from junctura.plans.queries import ORACLE_SQL, QUERIES

from tests.compare import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLE_SQL[name]) > 0
