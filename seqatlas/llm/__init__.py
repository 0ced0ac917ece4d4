"""Operators of a training-data pipeline: one module per operator, their queries in ``entries``."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Python tasks get these modules with the task, wherever the driver was started.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
