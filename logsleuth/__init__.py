"""logsleuth — Spark-native security-log analytics.

Every operator is a DataFrame -> DataFrame function built from Spark SQL
expressions, windows, joins and aggregates.  Sub-packages:

- ``sources``   file scans, parsers, manifests and sinks
- ``functions`` column-expression builders (regex entities, confidence, tokens)
- ``operators`` relational operators (series scores, detectors, reports)
- ``plans``     scale-safe plan shapes (row index, exact quantiles, joins)
- ``streaming`` Structured Streaming versions of the stateful operators
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run inside tasks are shipped by value: executors need the
# third-party libraries but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
