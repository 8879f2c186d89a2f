"""An operand is bound where all its figures are one; a fact without a figure, first or not, changes nothing."""

from decimal import Decimal

from ledgerlark.operators import verify as C


def test_bind(spark):
    rows = [(1, "m", 1, None), (1, "m", 2, "5"), (2, "m", 1, "5"), (2, "m", 2, "6"), (3, "m", 1, None), (4, "m", 1, "7"), (4, "m", 2, "7")]
    facts = spark.createDataFrame([(q, m, p, v and Decimal(v), "unit", "count") for q, m, p, v in rows], "question int, metric string, pos int, amount decimal(38,6), scale string, unit_kind string")
    assert {r.question: (r.value and int(r.value), r.bound) for r in C.bind(facts).collect()} == {1: (5, True), 2: (None, False), 3: (None, False), 4: (7, True)}
