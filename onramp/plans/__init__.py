"""Composed plans (scoring pipeline) and the query catalogue."""
