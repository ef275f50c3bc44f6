"""Worked examples of the pure expressions."""

import pytest
from pyspark.sql import functions as F

from cloakframe import functions as X
from cloakframe import sources as S

ITEM = "array<struct<attr:string,value:string>>"


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def items(*pairs):
    return F.array(*[F.struct(F.lit(a).alias("attr"), F.lit(v).alias("value")) for a, v in pairs])


@pytest.mark.parametrize(
    ("a", "b", "md5"),
    [
        ([("race", "White")], [("sex", "Male")], "18fdef940dd3907eddcd194c5bc3cc9a"),
        ([("workclass", "Private"), ("capital-gain", "(-0.1-9999.9]")], [("native-country", "United-States")], "039abe45d8df559236a95a3f2049c981"),
        ([("hours-per-week", "(30.4-40.2]")], [("capital-gain", "(-0.1-9999.9]")], "2a272177d75606d83879180a567f8ca6"),
    ],
)
def test_rule_hash(spark, a, b, md5):
    assert one(spark, X.rule_hash(items(*a), items(*b))) == (md5,)


def test_budgets(spark):
    s, c = F.lit(100), F.lit(0.8)
    assert one(spark, X.rule_budget(s, c, F.lit(False), 0.5), X.rule_budget(s, c, F.lit(False), 0.5, exact=True), X.rule_budget(s, c, F.lit(True), 0.5)) == (18.0, 75.0, 37.0)


def test_risk_and_moves(spark):
    risks = one(spark, *[X.group_risk(F.lit(n), 5) for n in (0, 3, 4, 5)])
    assert risks == (10, 7, 6, 0)
    moves = one(spark, *[X.migrant_count(F.lit(i), F.lit(i), F.lit(j), 5) for i, j in ((3, 4), (4, 3), (8, 3), (3, 6), (6, 7))])
    assert moves == (1, 2, 2, 3, 0)
    assert one(spark, X.risk_reduction(F.lit(3), F.lit(4), F.lit(1), 5), X.risk_reduction(F.lit(4), F.lit(3), F.lit(2), 5)) == (5, 5)
    assert one(spark, X.risk_reduction(F.lit(2), F.lit(3), F.lit(2), 5), X.most_useful(F.lit(2), F.lit(3), F.lit(2), 5)) == (15, True)
    assert one(spark, X.is_small(F.lit(2), 5), X.is_small(F.lit(3), 5), X.is_unsafe(F.lit(0), 5)) == (True, False, False)


MARITAL = {"Married-civ-spouse": ["Married-civ-spouse", "Married", "*"], "Married-AF-spouse": ["Married-AF-spouse", "Married", "*"], "Divorced": ["Divorced", "leave", "*"], "Separated": ["Separated", "leave", "*"], "Widowed": ["Widowed", "alone", "*"], "Married-spouse-absent": ["Married-spouse-absent", "alone", "*"], "Never-married": ["Never-married", "*"]}


def path(x):
    return F.array(*[F.lit(v) for v in MARITAL[x]])


def test_lca_and_depth(spark):
    assert one(spark, X.lca(path("Married-civ-spouse"), path("Married-AF-spouse")), X.lca(path("Divorced"), path("Never-married"))) == ("Married", "*")
    d = one(spark, X.depth_distance(path("Divorced"), path("Separated"), 3), X.depth_distance(path("Never-married"), path("Divorced"), 3))
    assert d == pytest.approx((1 / 3, 2 / 3))
    assert one(spark, X.width(F.lit(1), 7), X.width(F.lit(2), 7), X.width(F.lit(7), 7)) == pytest.approx((0, 2 / 7, 1))


def test_ranges(spark):
    b = X.range_bounds(F.lit("(-0.1-2523.6]"))
    got = spark.range(1).select(b["lo"], b["hi"], X.in_range(F.lit(0.0), b), X.in_range(F.lit(-0.1), b)).first()
    assert tuple(got) == (-0.1, 2523.6, True, False)
    row = {"age": F.lit(30), "sex": F.lit("Male")}
    assert one(spark, X.supports(items(("age", "(25-30]"), ("sex", "Male")), row), X.supports(items(("age", "30")), row), X.supports(items(("race", "x")), row)) == (True, True, False)
    assert one(spark, X.supports(items(("m", "Married")), {"m": F.lit("Married-civ-spouse")}, {"m": path("Married-civ-spouse")})) == (True,)


def test_bins_compat(spark):
    df = spark.createDataFrame([(13, 0), (20, 5), (80, 10)], "h int, g int")
    got = [tuple(r) for r in X.binned(df, ["h", "g"]).orderBy("h").collect()]
    assert ("(13.0-19.7]", "(0.0-1.0]") in got and ("(73.3-80.0]", "(9.0-10.0]") in got
    assert {r[0] for r in X.binned(df, ["h"], compat=True).collect()} >= {"nan"}
    assert "(-0.1-1.0]" in {r[1] for r in X.binned(df, ["g"], compat=True).select("h", "g").collect()}


def test_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text("39, State-gov, 7, Bachelors, 13, Never-married, Adm, Not-in-family, White, Male, 2174, 0, 40, United-States, <=50K\n50, ?, 8, Bachelors, 13, Married-civ-spouse, Exec, Husband, White, Male, 0, 0, 13, United-States, <=50K\n")
    rows = S.clean(S.read_census(spark, str(tmp_path / "c.csv"))).collect()
    assert [tuple(r) for r in rows] == [(39, "Male", "Never-married", "United-States", "White", "Bachelors", 40, 2174, "State-gov")]
    (tmp_path / "h.txt").write_text("a;x;*\nb;x;*\nc;*\n")
    h = S.read_hierarchy(spark, str(tmp_path / "h.txt"), "q")
    assert {(r["value"], r["level"], r["leaves"]) for r in X.nodes(h).collect()} == {("a", 2, 1), ("b", 2, 1), ("c", 1, 1), ("x", 1, 2), ("*", 0, 3)}
    (tmp_path / "t.txt").write_text("p, q\nr, s\n")
    assert sorted(r["items"] for r in S.read_transactions(spark, str(tmp_path / "t.txt")).collect()) == [["p_0", "q_1"], ["r_0", "s_1"]]
    users = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 3, "c")], "id int, o int, v string")
    codes = spark.createDataFrame([(1, "z"), (1, "y"), (1, "z"), (3, "q")], "id int, code string")
    assert [(r["id"], r["v"], r["codes"]) for r in S.users_with_conditions(users, codes, "id", "o", "code").collect()] == [(1, "a", ["y", "z"])]
    assert one(spark, S.render_range(F.lit(3.0), F.lit(7.5)), S.render_range(F.lit(-2.0), F.lit(-2.0))) == ("3-7.5", "-2")
