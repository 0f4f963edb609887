"""Operators that turn raw documents and pages into training data. Nothing else in the library imports this package."""

from pyspark import cloudpickle

import tamis.llm as _package

# Functions that run in Python workers travel with the task, so executors need no copy of the repository on their path.
cloudpickle.register_pickle_by_value(_package)
