import pytest

from offerlake.queries import ORACLES, QUERIES
from tests.compare import connection, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLES:
        want = connection(SF).sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_flagship_does_not_depend_on_partitions(spark):
    out = []
    for n in ("1", "2", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(rows(QUERIES["flagship"](spark, SF).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1] == out[2]
