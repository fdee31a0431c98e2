"""Every query against its oracle on the smallest tables; queries without one must give rows of their schema."""

import pytest

from loomline import catalogue
from tests.same import oracle_rows, rows


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.ORACLES:
        assert rows(df) == oracle_rows(duck, catalogue.ORACLES[name])
    else:
        df.collect()


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 729
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
