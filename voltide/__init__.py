"""voltide: futures and option volatility analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# functions sent to executors travel with their code, so that only the driver
# needs this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
