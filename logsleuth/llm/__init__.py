"""Training-data pipeline operators.

One module per operator; ``suite`` registers one query per operator and
``corpus_pipeline.py`` (repository top) chains five of them.  Nothing outside
this subpackage imports it.

Functions that run inside tasks are shipped by value, so executors need numpy,
pyarrow and the named third-party libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
