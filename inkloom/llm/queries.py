"""Queries of the training-data operators, by the names that the driver uses."""

from __future__ import annotations

from inkloom.llm import boilerplate, leaks, mixing, quality, readability, sentences, splitting, stuffing
from inkloom.llm.oracle import ORACLE_SQL

QUERIES = {
    name: f
    for module in (readability, boilerplate, sentences, quality, splitting, leaks, mixing, stuffing)
    for name, f in vars(module).items()
    if name[0] == "p" and name[1:].partition("_")[0].isdigit()
}

__all__ = ["ORACLE_SQL", "QUERIES"]
