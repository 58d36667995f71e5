"""DataFrame -> DataFrame operators (binning, windows, joins, state, metrics)."""
