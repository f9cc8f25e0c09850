"""Table operators: pooling, joins, folds, models, metrics, audits."""
