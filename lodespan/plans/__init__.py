"""Registered queries of the search corpus engine and the DuckDB SQL that gives the same rows."""

from lodespan.plans.corpus import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
