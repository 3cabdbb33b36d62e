"""Rule-based equity-signal analytics as Spark jobs over (tickers x days x scenarios)."""
