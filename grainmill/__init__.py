"""Spark-native analytics for retrieval corpora, their evaluation and their curation."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Workers get the functions of this package with the plan, so that it need not be installed on every executor.
register_pickle_by_value(sys.modules[__name__])
