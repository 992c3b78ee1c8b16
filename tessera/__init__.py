"""tessera: document-retrieval analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: what Python operators send travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
