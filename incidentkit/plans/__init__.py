"""Compositions of operators for whole business questions."""
