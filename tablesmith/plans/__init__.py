"""Registered queries: each runs an operator over whole tables, with an independent SQL check."""

from tablesmith.plans.base import ORACLES, QUERIES


def load_all() -> None:
    from tablesmith.plans import (  # noqa: F401
        auditing, charting, cleaning, files, modelling, profiling, relations, rules, streams,
    )


__all__ = ["ORACLES", "QUERIES", "load_all"]
