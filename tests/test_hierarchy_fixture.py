"""The class hierarchy of the test tables is whole: chains as long as an app has classes."""

from nomen.plans import registry


def test_chains_grow_with_the_parts(spark):
    n = registry.queries()["inherit_closure"](spark, "/root/testdata/sf0.01").groupBy("app", "child").count().agg({"count": "max"}).first()[0]
    assert n == 97  # 100 classes an app, those of the first 60 parts without a parent: the last of a chain has all before it
