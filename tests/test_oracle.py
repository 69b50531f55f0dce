"""Every query with SQL against that SQL, and every other one for rows."""

import __spark_entry__ as entry
from oracle import differences


def test_queries_agree_with_their_sql(spark, sf_dir):
    core = [n for m in entry.MODULES for n in __import__(m, fromlist=["ORACLE"]).ORACLE]
    assert [x for x in differences(spark, sf_dir, core) if x[1]] == []


def test_other_queries_run(spark, sf_dir):
    for m in entry.MODULES:
        module = __import__(m, fromlist=["QUERIES"])
        for name in set(module.QUERIES) - set(module.ORACLE):
            assert module.QUERIES[name](spark, sf_dir).count() > 0, name


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "score"]
