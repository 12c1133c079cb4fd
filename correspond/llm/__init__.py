"""Training-data operators: filters, near-duplicates, mixing, formatting and token files."""

from pyspark import cloudpickle

import correspond.llm as _self

# Functions of this subpackage travel to executors by value: no --py-files is needed.
cloudpickle.register_pickle_by_value(_self)
