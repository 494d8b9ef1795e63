"""Operators of a training-data pipeline.

Each module is one operator over any table with an identifier and a text column;
`registry` applies them to the tables of a folder. The code of tasks is pickled
with the job, so only the driver needs this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
