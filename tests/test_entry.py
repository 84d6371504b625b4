"""Driver contract: entry runs, every oracle key is a registered query."""

import __spark_entry__ as E
from lignum.operators import curate as U


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert set(df.columns) == {"lang", "n_trees", "p", "r", "f1"}


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 40


def test_split_sizes():
    assert U.split_sizes(10) == (7, 2, 1)
    assert U.split_sizes(20000) == (14000, 4000, 2000)
