"""Queries over the driver tables, by subject."""

from . import analytics, answers, digests, documents, evidence, reduction, relational, search, shapes, values  # noqa: F401
