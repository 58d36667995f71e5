"""Composed jobs (training, scoring, timeline) and the query registry."""
