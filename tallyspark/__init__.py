"""Analytics over event facts with Spark: relations, aggregates, windows, repairs, audits and report shapes."""
