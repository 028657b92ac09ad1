import pytest

from conftest import DATA
from quirefold.queries import ORACLES, QUERIES, _first_turns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_conversation_asks(spark):
    folder = DATA.replace("0.001", "0.01")
    every = spark.read.parquet(f"{folder}/conversations.parquet").where("turn = 0").select("conv_id").distinct()
    asked = [r.query_id for r in _first_turns(spark, folder).collect()]
    assert len(asked) > 18 and sorted(asked) == sorted(r.conv_id for r in every.collect())
