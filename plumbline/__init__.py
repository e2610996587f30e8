"""A contract-to-score analytics engine on Spark DataFrames.

Python functions that Spark sends to its workers travel by reference when this folder is on
PYTHONPATH, which workers inherit, and by value otherwise, so a job needs no installed copy.
"""

import os
import sys
from pathlib import Path

from pyspark.cloudpickle import register_pickle_by_value

_HERE = str(Path(__file__).resolve().parent.parent)
if _HERE not in [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
    register_pickle_by_value(sys.modules[__name__])
