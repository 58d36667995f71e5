"""visiflow: multi-sensor time-series features, joins, forecasting and scoring on Spark."""

__version__ = "0.1.0"
