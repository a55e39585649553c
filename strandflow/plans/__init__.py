"""Registered queries; the registry comes first, so that any of its modules can be imported alone."""

from strandflow.plans import registry  # noqa: F401
