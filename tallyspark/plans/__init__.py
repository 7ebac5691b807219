"""Pipelines composed from the operators (M1-M16) and the query catalogue."""
