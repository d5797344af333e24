"""Registered queries, each with the SQL that checks it."""

from corpusloom.plans import registry
from corpusloom.plans.registry import load_all

__all__ = ["load_all", "registry"]
