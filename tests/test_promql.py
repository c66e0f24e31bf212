"""Parsing."""

from __future__ import annotations

import pytest

from tsq.errors import InvalidRegex, NoName, ParsingWrong, Unsupported
from tsq.plans.logical import (
    EQUAL,
    NOT_EQUAL,
    NOT_REGEX,
    REGEX,
    WITH,
    WITHOUT,
    Aggregate,
    Call,
    Literal,
    Matcher,
    MatcherOp,
    Projection,
    Scan,
    Window,
)
from tsq.plans.promql import java_pattern, parse
from tsq.timemath import Instant, TimeRange
from tsq.types import string

NOW = Instant(1_000_000_000)
VALUE = Literal("value")


# Fixed value: the query text of the fixtures.
def test_composite():
    text = 'sum (rate(foo.bar.something_used{env="production", status!~"4.."}[5m] offset 1w)) by (test)'
    scan = Scan(
        "foo.bar.something_used",
        (
            Matcher("env", MatcherOp(EQUAL, string("production"))),
            Matcher("status", MatcherOp(NOT_REGEX, "4..")),
        ),
        projection=Projection(None, ("value",)),
    )
    got = parse(text, NOW)
    assert got == Aggregate("sum", WITH, ("test",), (Call("rate", (scan, VALUE)), VALUE), Window("first", None))
    wanted = got.args[0].args[0].range
    assert wanted.end.millis - wanted.start.millis == 300_000
    assert NOW.millis - wanted.end.millis == 7 * 86_400_000


def test_operators_and_strings():
    got = parse("m{a=\"x\\n\", b!='y', c=~`\\d+`, d!~\"z\",}", NOW)
    assert [m.op for m in got.matchers] == [
        MatcherOp(EQUAL, string("x\n")),
        MatcherOp(NOT_EQUAL, string("y")),
        MatcherOp(REGEX, "\\d+"),
        MatcherOp(NOT_REGEX, "z"),
    ]
    assert [m.op.positive for m in got.matchers] == [True, False, True, False]


def test_ranges():
    assert parse("m", NOW).range == TimeRange(None, NOW)
    assert parse("m[1h30m]", NOW).range.start == Instant(NOW.millis - 5_400_000)
    assert parse("m offset 1s", NOW).range.end == Instant(NOW.millis - 1000)
    assert parse("m offset -1s", NOW).range.end == Instant(NOW.millis + 1000)
    assert parse('{__name__="m"}', NOW).resource == "m"
    assert parse("m", NOW) == parse("m[5m]", NOW)  # equality ignores the range


def test_aggregates():
    assert parse("sum by (a, b) (m)", NOW) == parse("sum(m) by (a, b)", NOW)
    assert parse("max without (a) (m)", NOW).action == WITHOUT
    assert isinstance(parse("sum(m)", NOW), Call)
    assert parse("sum(m) by ()", NOW).by == ()


@pytest.mark.parametrize("text", ["{}", '{a="b"}', "{}[5m]"])
def test_no_name(text):
    with pytest.raises(NoName):
        parse(text, NOW)


@pytest.mark.parametrize(
    "text",
    ["1", '"x"', "-m", "a + b", "a and b", "sum(a + b)", "m[5m:1m]", "topk(2, m)", '{__name__=~"m"}', "(m)", "m @ 3"],
)
def test_unsupported(text):
    with pytest.raises(Unsupported):
        parse(text, NOW)


@pytest.mark.parametrize("text", ["", "m{", "m{a}", "m[5]", "m[", 'm{a="b"', "m)", 'm{a>"b"}', "m{a='\\q'}", "~", "f(", 'm{__name__="n"}'])
def test_wrong(text):
    with pytest.raises(ParsingWrong):
        parse(text, NOW)


def test_regex_rules():
    for wrong in ("(?=a)", "(?<!a)b", "(a)\\1", "(?>a)", "a\\"):
        with pytest.raises(InvalidRegex):
            java_pattern(wrong)
    assert java_pattern("(?P<x>a)[(?=]") == "(?U)(?<x>a)[(?=]"


def test_invalid_regex_fails_at_parse(spark):
    from tsq.engine import Engine

    with pytest.raises(InvalidRegex):
        Engine(spark).parse('m{a=~"("}')
