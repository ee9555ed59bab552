"""Multi-view reconstruction analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from .model import Recon
from .session import cut, get_session

# Kernels travel to the executors with the job, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Recon", "cut", "get_session"]
