"""Imports every module that registers queries."""

from . import aggregates, geometry, jobs, networks, rules, tables, texts  # noqa: F401
