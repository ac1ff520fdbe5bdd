"""fablens: equipment-log analytics expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its few Python functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
