"""Lines of JSON: each is parsed once, and judged as a change or by what is wrong with it."""

from colmerge.sources.tables import from_wire, judged_lines, rejected_lines

GOOD = '{"tbl":"t","pk":"r","cid":"c","val":null,"site_id":"A","col_version":1,"cl":1,"seq":0,"db_version":2}'
LINES = [GOOD, " \t" + GOOD, "~" + GOOD[:20], GOOD[:20], None, "", "[1]", "3", GOOD.replace('"db_version":2', '"db_version":"x"'), GOOD.replace('"r"', "null"), GOOD.replace('"db_version":2', '"db_version":null'), "[" + GOOD + "]"]


def test_lines_are_judged_once(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    told = [r["reason"] for r in judged_lines(lines).collect()]
    assert told == [None, None, "no object", "no object", "empty", "no object", "no object", "no object", "unreadable", "no key", "no version", "no object"]
    assert from_wire(lines).count() == 2 and rejected_lines(lines).count() == 10
    upper = lines.selectExpr("concat(value, ' ') value")
    for rows in (from_wire(upper), rejected_lines(upper)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1 and plan.count("concat(") == 1
