"""Numbers as text: beside a plain version, and each part computed once a value."""

import math
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from nestframe.functions import text
from nestframe.queries import QUERIES

EDGES = [0.0, -0.0, 1.0, -1.0, 0.1, 1e-4, 9.999e-5, 1e-6, 9.999999e-7, 1e-7, 999999.0, 1e6, 999999.5, 1234567.0, 9999999.0, 1e7, 1.05e7, 1e20, 1e21, 9.99e20, 100.0, 1020.5, 0.00102, 4.9e-324, 1.7976931348623157e308, -2.5e-300, 0.001, 1e-3, 120000.0]


def values() -> list[float]:
    rng = random.Random(7)
    bits = [struct.unpack("d", rng.randbytes(8))[0] for _ in range(500)]
    return EDGES + [v for v in bits if v - v == 0] + [rng.choice((1, -1)) * round(rng.random() * 10 ** rng.randint(-8, 23), rng.randint(0, 9)) for _ in range(500)]


def plainly(java: str, low: int, high: int, width: int) -> str:
    """Of Java's digits: plain, or with an exponent where the first digit's power is below ``low`` or from ``high`` on."""
    sign, digits, exponent = Decimal(java).normalize().as_tuple()
    digits, minus = "".join(map(str, digits)), "-" if sign else ""
    if digits == "0":
        return minus + "0"
    power = len(digits) - 1 + exponent
    if power < low or power >= high:
        return f"{minus}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'-' if power < 0 else '+'}{abs(power):0{width}d}"
    return minus + format(Decimal((0, tuple(map(int, digits)), exponent)), "f")


@pytest.mark.parametrize("of, low, high, width", [(text.shown, -4, 6, 2), (text.number, -6, 21, 1)])
def test_numbers_are_those_of_a_plain_version(spark, of, low, high, width):
    df = spark.createDataFrame([(v,) for v in values()], "v double")
    for v, java, got in df.select("v", F.col("v").cast("string"), of(F.col("v"))).collect():
        assert got == plainly(java, low, high, width), v


def test_values_that_are_not_finite(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v double")
    assert [tuple(r) for r in df.select(text.shown(F.col("v")), text.number(F.col("v"))).collect()] == [("NaN", None), ("+Inf", None), ("-Inf", None), (None, None)]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("of", [text.shown, text.number])
def test_a_number_is_computed_once(spark, of):
    plan = plan_of(spark.range(3).select(of(F.cbrt("id")).alias("text")))
    assert plan.count("CBRT(") == 1 and "regexp" not in plan


#: Queries that write numbers as text.
NAMES = ["int_from_float", "string_coerce", "float_to_string", "json_number"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_compute_the_parts_of_numbers_once(spark, tiny, name):
    plan = plan_of(QUERIES[name](spark, tiny))
    assert "regexp" not in plan and len(plan) < 10_000


@pytest.mark.parametrize("of, low, high, width", [(text.shown, -4, 6, 2), (text.number, -6, 21, 1)])
def test_numbers_beside_powers_of_ten(spark, of, low, high, width):
    near = [sign * v for p in range(-9, 25) for v in (float(f"1e{p}"), math.nextafter(float(f"1e{p}"), 0), math.nextafter(float(f"1e{p}"), math.inf), float(f"1.2e{p}")) for sign in (1, -1)]
    for v, java, got in spark.createDataFrame([(v,) for v in near], "v double").select("v", F.col("v").cast("string"), of(F.col("v"))).collect():
        assert got == plainly(java, low, high, width), v


#: Queries whose every row is a number as text.
EVERY_ROW = ["string_coerce", "float_to_string", "json_number"]


@pytest.mark.parametrize("name", EVERY_ROW)
def test_only_a_number_and_its_text_are_bound(spark, tiny, name):
    """Each further lambda makes an array a row, outside of code generation."""
    plan = plan_of(QUERIES[name](spark, tiny))
    assert plan.count("lambdafunction(") == 2 and "struct" not in plan
