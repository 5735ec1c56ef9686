from tidewire.operators import listings

SHAPE = "short_name string, catalogue_name string, search int, place int, symbol string, quote_type string, exchange string, long_name string, other_name string"
QUOTED = "symbol string, price double, exchange string, currency string"


def found(spark, *rows):
    return spark.createDataFrame([("APP", "AppLovin Corp", 0, i, *r) for i, r in enumerate(rows)], SHAPE)


def test_best_listing(spark):
    rows = found(
        spark,
        ("APP.AX", "EQUITY", "ASX", "Appen Limited", None),  # another company
        ("0APP.L", "EQUITY", "LSE", "AppLovin Corporation", None),  # international board
        ("APP.DE", "EQUITY", "GER", None, "AppLovin Corp"),
        ("APP", "equity", "NMS", "AppLovin Corporation", None),
        ("APP", "EQUITY", "XXX", "AppLovin Corporation", None),  # found again
        ("3APP", "ETF", "NMS", "Leverage Shares 3x Long AppLovin Corp ETP", None),
        ("APPX", "OPTION", "NMS", "AppLovin Corp", None),
        (None, "EQUITY", "NMS", "AppLovin Corp", None),
    )
    assert [(r.symbol, r.rank) for r in listings.ranked(rows).orderBy("pick").collect()] == [("APP", 0), ("APP.DE", 3), ("0APP.L", 8)]
    quotes = spark.createDataFrame([("APP", None, "NMS", "USD"), ("APP.DE", 70.0, "", "EUR"), ("0APP.L", 60.0, "LSE", "GBP")], QUOTED)
    assert [tuple(r) for r in listings.resolved(rows, quotes).collect()] == [("APP", "APP.DE", "GER", "EUR", 70.0)]
    assert listings.resolved(rows, quotes.limit(0)).count() == 0


def test_exact_symbol_counts_whatever_the_name(spark):
    rows = found(spark, ("app", "EQUITY", "PAR", "Quite Other SA", None), ("APP.PA", "EQUITY", "PAR", "Quite Other SA", None))
    assert [r.symbol for r in listings.ranked(rows).collect()] == ["app"]
