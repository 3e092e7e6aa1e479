"""The confidence of order matches is a decimal as in its SQL: 0.8 as a double isn't 0.8."""

from decimal import Decimal

from ledgerkit.plans.queries import QUERIES


def test_confidence_is_exact(spark):
    df = QUERIES["order_matches"](spark, "/root/testdata/sf0.001")
    assert df.schema["confidence"].dataType.simpleString() == "decimal(2,1)"
    got = {(r.method, r.confidence) for r in df.select("method", "confidence").distinct().collect()}
    assert got == {("exact", Decimal("1.0")), ("window", Decimal("0.8")), ("charge_only", Decimal("1.0"))}
