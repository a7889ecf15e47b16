"""Operators for preparing text corpora, with their queries."""

import sys

from pyspark import cloudpickle

# Functions for tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def load_all() -> None:
    from tablesmith.llm import queries  # noqa: F401
