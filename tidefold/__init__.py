"""Report pipelines on Spark: validation, keyed folds, exports and monthly publication."""
