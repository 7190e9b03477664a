"""Cue tables, parallel-text stores and corpus preparation as Spark DataFrame operators."""
