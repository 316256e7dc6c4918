"""Imports every module that registers queries."""

from collatium.plans import aggregates, editions, margins, matching, reading, sequences  # noqa: F401
