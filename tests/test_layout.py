"""Tables by key: lookups read one bucket, joins need no shuffle."""

import collections

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from altscore.plans import q_layout as P
from altscore.sources import layout as L
from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _files_read(df):
    """Files that the tasks of the scan of ``df`` are given."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    parts = [p for i in range(leaves.size()) for p in leaves.apply(i).inputRDD().partitions()]
    return len({f.urlEncodedPath() for p in parts for f in p.files()})


def _bag(df):
    return collections.Counter(map(tuple, df.collect()))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def tables(spark):
    """A hot key with a third of the rows, null keys, repeated rows, keys without a partner."""
    parents = spark.range(200).selectExpr("IF(id % 50 = 49, null, id) AS k", "concat('p', id) AS p")
    children = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 100 = 1 THEN null ELSE id % 400 END AS k", "id % 1000 AS c")
    return parents, children, L.write_keyed(parents, "k", "t_parents"), L.write_keyed(children, "k", "t_children", ids=("c",))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_joins_equal_plain_joins(tables, how):
    parents, children, p, c = tables
    assert c.hot_keys == (7,) and p.hot_keys == ()
    for (a, ka), (b, kb) in (((parents, p), (children, c)), ((children, c), (parents, p))):
        want = a.join(b, "k", how)
        assert _bag(L.join_keyed(ka, kb, how).select(want.columns)) == _bag(want)


def test_buckets_join_without_exchange(no_broadcast, spark):
    p = L.write_keyed(spark.range(1000).selectExpr("id AS k"), "k", "t_plain")
    c = L.write_keyed(spark.range(5000).selectExpr("id % 1000 AS k", "id AS c"), "k", "t_many")
    joined = p.cold.join(c.cold, "k")
    assert (p.hot_keys, c.hot_keys) == ((), ())
    assert "SortMergeJoin" in _plan(joined) and "Exchange" not in _plan(joined)
    assert "Exchange" not in _plan(L.join_keyed(p, c))
    assert L.join_keyed(p, c).count() == 5000


@pytest.mark.parametrize("name", ["join_keyed_predictions", "join_keyed_audit"])
def test_registered_joins_exchange_nothing(no_broadcast, spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_lookup_reads_one_bucket(tables):
    _, children, _, c = tables
    found = c.lookup(8)
    assert "EqualTo(k,8)" in _plan(found)                           # pushed to the scan
    assert _bag(found) == _bag(children.filter("k = 8"))
    assert _files_read(found) == 1 and _files_read(c.cold) == 8


@pytest.mark.parametrize("value", [7, None, 9999])
def test_lookup_of_hot_missing_and_no_key(tables, value):
    _, children, _, c = tables
    assert _bag(c.lookup(value)) == _bag(children.filter(F.col("k").eqNullSafe(F.lit(value))))


def test_empty_and_unlike_tables(spark, tables):
    _, _, p, c = tables
    none = L.write_keyed(spark.createDataFrame([], "k long, x string"), "k", "t_none")
    assert none.rows().count() == 0 and none.lookup(1).count() == 0
    assert L.join_keyed(none, c).count() == 0
    assert L.join_keyed(p, none).count() == p.rows().count()
    with pytest.raises(ValueError):
        L.join_keyed(p, L.write_keyed(spark.range(3).selectExpr("id AS k"), "k", "t_three", buckets=3))
