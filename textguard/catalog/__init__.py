"""Registered queries over the driver tables, each with its SQL counterpart where one exists."""

from textguard.catalog import base


def load_all() -> None:
    """Import every query module so that its queries are registered."""
    from textguard.catalog import (  # noqa: F401
        evaluation,
        explaining,
        ingestion,
        learning,
        texts,
        vectors,
    )


def queries() -> dict:
    load_all()
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    load_all()
    return dict(base.ORACLES)
