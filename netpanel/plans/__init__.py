"""The registered queries."""

from __future__ import annotations

from .registry import CATALOGUE, Query


def catalogue() -> dict[str, Query]:
    """All queries by name; importing a module registers what it holds."""
    from . import models, ordered, relational  # noqa: F401

    return CATALOGUE
