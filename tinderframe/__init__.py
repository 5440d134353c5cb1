"""Station time-series and weather-grid operators for PySpark.

Every operator is a plain ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function. See ``README.md`` for the list of modules.
"""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so executors do not
# need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
