"""cuemill: timed-text analytics as keyed, lazy Spark DataFrame operators."""
