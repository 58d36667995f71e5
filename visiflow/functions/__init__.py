"""Scalar column expressions (values, times, names, geo, weather)."""
