"""Registered queries: each runs a library operator over whole driver tables and,
where SQL can say it, carries the SQL that must give the same rows."""

from __future__ import annotations


def _load() -> None:
    from registered import (  # noqa: F401
        cleaning,
        evaluation,
        exploration,
        features,
        modelling,
        monitoring,
        storage,
        streams,
        validation,
    )


def all_queries() -> dict:
    from registered.base import QUERIES

    _load()
    return dict(QUERIES)


def all_checks() -> dict:
    from registered.base import CHECKS

    _load()
    return dict(CHECKS)
