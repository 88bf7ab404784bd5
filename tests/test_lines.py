"""Files in several splits give the same rows as files in one, and ill-formed logs are told."""

import random

import pytest
from pyspark.sql import functions as F

from nomen.operators import lines, mapping
from nomen.sources import text


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("block", [1, 3, 10, 1000])
def test_carry_down(spark, block):
    r = random.Random(block)
    data = [(app, i, r.choice([None, None, f"h{i}"])) for app in ("a", "b", None) for i in range(0, 60, r.randrange(1, 4))]
    want, last = [], {}
    for app, i, h in data:
        last[app] = h or last.get(app)
        want.append((app, i, h, last[app]))
    df = spark.createDataFrame(data, "app string, line long, header string").withColumn("k", F.lit(1)).withColumn("own", F.lit(2))
    got = lines.carry_down(df, F.col("header"), "found", block_lines=block)
    assert rows(got.select("app", "line", "header", "found")) == sorted(want, key=str) and got.columns == [*df.columns, "found"]
    assert lines.carry_down(df.where("false"), F.col("header"), "found").count() == 0


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def mapping_text(n):
    out = []
    for i in range(n):
        out.append(f"com.example.Klass{i} -> com.a.c{i}:")
        out += [f"    com.example.Klass{j} field{j} -> f{j}" for j in range(i % 4)]
        out += [f"    void run{j}(com.example.Klass{i},int) -> r{j}" for j in range(i % 3)]
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_files(spark, tmp_path, small_splits, end):
    files = {"one.txt": mapping_text(40), "two.txt": ["", "x", "", ""] + mapping_text(9), "none.txt": []}
    for name, content in files.items():
        (tmp_path / name).write_bytes("".join(x + end for x in content).encode())
    read = text.load_lines(spark, str(tmp_path))
    got = {}
    for app, line, value in read.collect():
        got.setdefault(app.rsplit("/", 1)[1], {})[line] = value
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: v for k, v in files.items() if v}
    parsed = rows(mapping.parse_mapping(read.withColumn("app", F.regexp_extract("app", "([^/]+)$", 1))))
    whole = [(name, i, x) for name, content in files.items() for i, x in enumerate(content)]
    want = rows(mapping.parse_mapping(spark.createDataFrame(whole, "app string, line long, value string")))
    assert parsed == want and len(want) > 100


def test_split_counts(spark, tmp_path, small_splits):
    (tmp_path / "one.txt").write_text("\n".join(mapping_text(40)))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert text.load_lines(spark, str(tmp_path)).count() == len(mapping_text(40))
