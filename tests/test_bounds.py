import pytest

from profloom.functions import scalars
from pyspark.sql import functions as F

CASES = {
    "O(1)": "O(1)", "7": "O(1)", "O(n)": "O(n^1)", "O(n^2)": "O(n^2)", "3*n^2 + 5*n + 1": "O(n^2)", "n*m": "O(n^2)", "O(n*log(n))": "O(n^1 log(n))", "log(n)": "O(log(n))",
    "n + log(n)*log(m)": "O(n^1)", "log(n)^2": "O(log(n)^2)", "(n + 1)*(m^2 + 4)": "O(n^3)", "(n+1)^2*log2(n)": "O(n^2 log(n))", "max(0, n) + max(m, 4)": "O(n^1)", "n**3 - 2*n": "O(n^3)",
    "2^n": "O(c^n)", "n^m + n": "O(c^n)", "1^n": "O(1)", "n^0.5": "O(n^0.5)", "2*n*n^2": "O(n^3)", "max(n, n*log(n))": "O(n^1 log(n))", "(n + log(n))*n": "O(n^2)", "log(8)": "O(1)", "n ^ 2 * 10": "O(n^2)",
    "((n))": None, "n +": None, "": None, "O(\u221e)": None, None: None,
}


def test_classes_of_bounds(spark):
    df = spark.createDataFrame([(b,) for b in CASES], "b string")
    found = {r.b: r.c for r in df.select("b", scalars.complexity_of(F.col("b")).alias("c")).collect()}
    assert found == CASES


@pytest.mark.parametrize("order", [["5", "log(n)", "log(n)^2", "n^0.5", "n", "n*log(n)", "n*m", "n^2*log(n)", "n^3", "2^n"]])
def test_growth_orders_bounds(spark, order):
    df = spark.createDataFrame([(b,) for b in reversed(order)], "b string")
    assert [r.b for r in df.orderBy(scalars.bound_growth(F.col("b"))).collect()] == order
    assert df.agg(F.max_by("b", scalars.bound_growth(F.col("b")))).first()[0] == "2^n"
