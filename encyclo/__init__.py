"""encyclo: Spark-native analytics over encyclopedia corpora.

DataFrame in, DataFrame out.  Sub-packages:

* ``sources``   -- dump / TSV / corpus readers, sinks, role views over the driver tables
* ``functions`` -- column expressions (markup, tokenizing, vectors)
* ``operators`` -- joins, aggregations, hierarchy, corpus statistics, vectors, graph search, learning
* ``plans``     -- join helpers and the registry of checked queries
* ``streaming`` -- incremental page ingest
"""

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers are shipped whole, so executors need no
# copy of the package on their path.
_cloudpickle.register_pickle_by_value(__import__(__name__))

__version__ = "0.1.0"
