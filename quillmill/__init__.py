"""quillmill: document review and corpus preparation as Spark plans.

Functions that run on executors are pickled by value, so that a cluster needs
nothing installed but PySpark's own requirements.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
