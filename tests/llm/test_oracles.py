import pytest
from compare import agree

from millrace.llm.oracle import ORACLE
from millrace.llm.queries import queries


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf_dir, name):
    agree(spark, sf_dir, queries()[name], ORACLE[name])
