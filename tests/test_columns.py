"""Golden values of the column functions."""

import pytest
from pyspark.sql import functions as F

from nomen.functions import columns as C
from nomen.functions import similarity


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def text(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(
    ("name", "words"),
    [
        ("mMyActivity", "m my activity"),
        ("MyAwesomeClass", "my awesome class"),
        ("MY_AWESOME_FIELD", "my awesome field"),
        ("AWESOMEMethod", "awesome method"),
        ("parse_names", "parse names"),
        ("create_myAwesomeClass_COMPAT", "create my awesome class compat"),
        ("create_myAwesomeClass$SubClass$access1000", "create my awesome class $ sub class $ access"),
        ("<init>", "<init>"),
        ("x", "x"),
        ("", ""),
    ],
)
def test_split_name(spark, name, words):
    assert value(spark, F.array_join(C.split_name(text(name)), " ")) == words


@pytest.mark.parametrize(("a", "b", "expected"), [("Hello_world", "HelloWorldHAHA", 2 / 3), ("a", "b", 0.0), ("getData", "get", 0.5), ("", "", 1.0)])
def test_word_similarity(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert similarity.with_name_similarity(df, "a", "b").first()["similarity"] == pytest.approx(expected)


def test_edit_distance_by_recursion():
    def slow(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(slow(a[1:], b) + 1, slow(a, b[1:]) + 1, slow(a[1:], b[1:]) + (a[0] != b[0]))

    import random

    r = random.Random(1)
    for _ in range(60):
        a, b = ([r.choice("xyz") for _ in range(r.randrange(5))] for _ in range(2))
        assert similarity.edit_distance(a, b) == slow(a, b)


@pytest.mark.parametrize(("name", "bad"), [("a", True), ("ab", True), ("os", False), ("abc", False), (None, True), ("s;", False), ("$abc$x", False), ("$a$long", True)])
def test_name_obfuscated(spark, name, bad):
    assert value(spark, C.is_name_obfuscated(text(name))) is bad


@pytest.mark.parametrize(("name", "bad"), [("R", False), ("R$a", True), ("R$layout", False), ("a", True), (None, True)])
def test_class_name_obfuscated(spark, name, bad):
    assert value(spark, C.is_class_name_obfuscated(text(name))) is bad


@pytest.mark.parametrize(("id_", "bad"), [("com.foo.a", True), ("com.a.bar", True), ("com.foo.bar", False), ("foo", False), ("com.Foo.a$1", True)])
def test_method_minified(spark, id_, bad):
    assert value(spark, C.is_method_minified(text(id_))) is bad


@pytest.mark.parametrize(("lib", "short", "ok"), [("com.lib.Foo.get", "com.lib.a.b", True), ("com.lib.Foo.get", "com.libs.a.b", False), ("com.lib.Foo", "a.b", False)])
def test_names_compatible(spark, lib, short, ok):
    assert value(spark, C.names_compatible(text(lib), text(short))) is ok


def test_numbers(spark):
    assert value(spark, C.safe_divide(F.lit(3), F.lit(0))) == 1.0
    assert value(spark, C.safe_divide(F.lit(1), F.lit(4))) == 0.25
    assert value(spark, C.percent(F.lit(0), F.lit(0))) == "-"
    assert value(spark, C.percent(F.lit(1), F.lit(3))) == "33.33%"


def test_signatures(spark):
    assert value(spark, C.member_key(text("<a.B: int x>"), text("field"))) == "a.B;->x:int"
    assert value(spark, C.member_key(text("<a.B: void f(int,a.C)>"), text("method"))) == "a.B;->f(int,a.C)"
    assert value(spark, C.member_key(text("broken"), text("method"))) is None
    assert value(spark, C.member_key(text("a.B"), text("class"))) == "a.B"
    assert value(spark, C.belonging_package(text("method"), text("<a.b.C: void f()>"))) == "a.b"
    assert value(spark, C.belonging_package(text("class"), text("Foo"))) == ""
    assert value(spark, C.belonging_package(text("class"), text("Foo"), strict=True)) == "Fo"
    assert value(spark, C.belonging_package(text("modifier"), text("public"))) is None
    assert value(spark, C.array_element_type(text("type"), text("int[][]"))) == "int"
    assert value(spark, C.array_element_type(text("class"), text("int[]"))) is None
    assert value(spark, C.qualify_relation(text("package"), text("class"), text("XX_contains"))) == "P_C_contains"
    assert value(spark, C.qualify_relation(text("method"), text("type"), text("MT_parameter"), F.lit(False), F.lit(True))) == "M_[T_parameter"
    assert value(spark, C.entity_name(text("method_lib"), text("f"), text("<a: void f()>"))) == "method_lib:<a:~void~f()>"
    assert value(spark, C.translate_types(text("Foo,Foo[],int"), F.create_map(F.lit("Foo"), F.lit("a")))) == "a,Foo[],int"


def test_screens_and_paths(spark):
    assert value(spark, C.normalise_activity(text("p.q/.Main"), text("p.q"))) == "p.q.Main"
    assert value(spark, C.normalise_activity(text("p.q/x.Main"), text("p.q"))) == "x.Main"
    assert value(spark, C.generalise(text("My-App_2"))) == "myapp2"
    parts = lambda p: tuple(value(spark, C.artifact_parts(text(p))))
    assert parts("/p/build/outputs/mapping/full/release/mapping.txt") == ("/p", "/full", "mapping")
    assert parts("/p/build/outputs/apk/full-debug.apk") == ("/p", "full", "debug")
    assert parts("/p/bin/x-release-unsigned.apk") == ("/p", "", "release")
    assert parts("/p/x-unaligned.apk")[2] == "skipped"
    assert parts("/p/readme")[2] == "unknown"


def test_common_substring(spark):
    assert value(spark, C.common_substring(text("getName"), text("NAMEs"))) is True
    assert value(spark, C.common_substring(text("ab"), text("ab"))) is True
    assert value(spark, C.common_substring(text("abcd"), text("abxcd"))) is False
    assert value(spark, C.common_substring(text(None), text("abc"))) is False
