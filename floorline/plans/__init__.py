"""Importing this package registers every query."""

from . import calls, evaluation, exchange, release, tables, timeline  # noqa: F401
