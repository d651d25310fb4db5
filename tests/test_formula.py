from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions.specs import KERNEL_DIFFERS, SPECS, Registry
from tessera.plans.compiler import Plan
from tessera.plans.formula import canonical, digest, distinct, family, from_qlib, mechanism, parse, to_qlib, try_parse


def test_there_are_84_operators():
    assert len(SPECS) == 84
    assert KERNEL_DIFFERS <= set(SPECS)


def test_defaults_and_text_form():
    assert str(parse("Mean($close)")) == "Mean($close, 10)"
    assert str(parse("Add($close, -2)")) == "Add($close, -2)"
    tree = parse("CsRank(Div(Sub($close, Mean($close, 6)), Std($close, 6)))")
    assert tree.depth == 5 and tree.size == 8 and tree.leaves == ["$close"]


@pytest.mark.parametrize("text", ["$close + 1", "Mean($close", "Nope($close)", "Add($close)", "Mean($close, 3, 4)", "Mean($close, $open)", "", "Mean($close) $open"])
def test_what_is_no_formula(text):
    assert try_parse(text) is None


def test_strict_ranges():
    with pytest.raises(SyntaxError):
        parse("Mean($close, 1000)", strict=True)


def test_canonical_form():
    same = [("Add($close, $open)", "Add($open, $close)"), ("Max2($close, 1)", "Max(1, $close)"), ("Neg(Neg($close))", "$close"), ("Mul($amt, 1)", "$amount"), ("Abs(Neg($low))", "Abs($low)")]
    for a, b in same:
        assert digest(parse(a)) == digest(parse(b)), (a, b)
    assert digest(parse("Sub($close, $open)")) != digest(parse("Sub($open, $close)"))
    assert str(canonical(parse("Med($close, 5)"))) == "Median($close, 5)"


def test_families_and_other_language():
    assert family(parse("Corr($close, $volume, 5)")) == "PV-Correlation" and family(parse("Corr($close, $open, 5)")) == "Other"
    assert family(parse("Delta($close, 2)")) == "Momentum" and mechanism("Momentum") == "Trend/Momentum" and mechanism("Price-Volume") == "Price-Volume"
    assert family(parse("CsRank($amt)")) == family(parse("CsRank($amount)")) == "Amount"
    assert distinct({"a": "Add($close, $open)", "b": "Add($open, $close)", "c": "$vwap"}) == {"b": "a"}
    text, missing = to_qlib(parse("Neg(TsMax($close, 5))"))
    assert text == "Mul(Max($close, 5), -1)" and not missing
    assert to_qlib(parse("CsRank($close)"))[1] == ["CsRank"]
    assert str(from_qlib("Max(Ref($close, 2), 5)")) == "TsMax(Delay($close, 2), 5)"
    for divergent in ("Log($close)", "TsRank($close, 5)", "TsArgMax($close, 5)", "TsArgMin($close, 5)", "IfElse($close, 1, 2)", "And($close, $open)", "Or($close, $open)", "Not($close)"):
        assert to_qlib(parse(divergent))[1] == [divergent.split("(")[0]]
    for divergent in ("Log($close)", "Rank($close, 5)", "Mean(If($close, 1, 2), 5)"):
        with pytest.raises(SyntaxError):
            from_qlib(divergent)


def test_only_needed_leaves_are_read():
    assert Plan({"a": "Mean($close, 3)", "b": "Add($open, $amt)"}).leaves == ["amount", "close", "open"]


def test_own_operator_parses_and_runs(spark):
    registry = Registry()
    registry.register("Twice", 1, lambda x: x * 2)
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0)], "asset_id string, t_idx int, close double")
    got = Plan({"v": "Twice(Delta($close, 1))"}, registry=registry).apply(df).orderBy("t_idx").collect()
    assert [r.v for r in got] == [None, 4.0]
    with pytest.raises(ValueError):
        registry.register("Mean", 1, lambda x: x)


def test_shared_stages(spark):
    df = spark.createDataFrame([("a", 0, 1.0)], "asset_id string, t_idx int, close double")
    many = Plan({f"f{i}": f"CsRank(Sub(Mean($close, 3), Std($close, {3 + i})))" for i in range(5)}).apply(df)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(asset_id") == 1 and plan.count("hashpartitioning(t_idx") == 1
    assert many.select(F.count("f0")).first()[0] == 0
