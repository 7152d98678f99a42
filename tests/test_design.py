import pytest

from design import CASES


@pytest.mark.parametrize("name", CASES)
def test_design(spark, name):
    question, columns, want = CASES[name]
    got = question(spark, None)
    assert got.columns == columns
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
