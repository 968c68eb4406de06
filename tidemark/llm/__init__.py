"""Operators of a training-data pipeline over document tables.

Python workers import this package by name where it is installed or on ``PYTHONPATH``. Where only
the driver can find it, its functions travel with the tasks instead.
"""

import os
import sys
from pathlib import Path

from pyspark import cloudpickle

_root = Path(__file__).resolve().parents[2]
_seen = {Path(p or ".").resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), "."]}
if _root not in _seen and _root.name != "site-packages":
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
