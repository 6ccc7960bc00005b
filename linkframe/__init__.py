"""Typed, linked entity tables on Spark."""
