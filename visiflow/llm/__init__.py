"""Operators for training-data pipelines (see README, section "LLM data operators")."""
