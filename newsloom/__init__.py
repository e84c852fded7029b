"""newsloom: news-recommendation analytics written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from newsloom.session import build_session, ensure_checkpoint_dir, pin

__all__ = ["build_session", "ensure_checkpoint_dir", "pin"]

# Task functions travel with their code, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
