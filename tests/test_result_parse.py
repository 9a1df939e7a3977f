"""Result lines are made once, not again for each path that is read from them."""

from glossaria.plans.queries import QUERIES


def test_lines_are_made_once(spark):
    plan = QUERIES["result_parse"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_extract(") <= 4  # one for each kind of line that quotes the answer
