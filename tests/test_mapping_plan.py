"""Line patterns are met once a line: what reads the parsed lines never evaluates them again."""

from nomen.operators import mapping


def test_no_pattern_after_the_written_lines(spark):
    lines = spark.createDataFrame([("a", 0, "x.A -> b.B:"), ("a", 1, "    int f -> g"), ("a", 2, "junk"), ("a", 3, "    void r(int,x.A) -> s")], "app string, line long, value string")
    for found in (mapping.parse_mapping(lines), mapping.signature_map(lines)):
        plan = found._jdf.queryExecution().toString()
        assert "RLIKE" not in plan and "Window" not in plan
    rows = {(r.kind, r.key, r.value) for r in mapping.parse_mapping(lines).collect()}
    assert rows == {("p", "b", "x"), ("c", "b.B", "A"), ("f", "b.B;->g:int", "f"), ("m", "b.B;->s(int,b.B)", "r")}
