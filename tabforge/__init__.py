"""tabforge: data preparation, profiling, training and versioning on PySpark.

Every public function takes and returns DataFrames and can be used through
``df.transform``.  Planning, pushdown, code generation, shuffles and spilling
are Spark's; the library only declares the plan.
"""

import sys

from pyspark import cloudpickle

# Task code (mapInPandas helpers, data sources) travels to the executors by
# value, so a cluster needs no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
