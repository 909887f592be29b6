"""Operators over the tables of :mod:`factweave.schema`; each takes and returns DataFrames."""
