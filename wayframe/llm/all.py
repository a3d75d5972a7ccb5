"""Imports every module that registers queries."""

from . import brown, contamination, lines, mixing, negatives, neighbours, ngrams, quality, repair, sharding, suffixes, templates, toxicity  # noqa: F401
