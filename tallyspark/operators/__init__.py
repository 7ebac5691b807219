"""DataFrame -> DataFrame operators (classification, joins, history, measures, pivots, windows, quality)."""
