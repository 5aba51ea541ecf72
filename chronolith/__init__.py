"""A Spark engine for multi-timeframe series: bars, as-of joins, features, labels, evaluation."""
