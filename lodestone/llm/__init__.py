"""Training-data operators: sharding, cleaning, matching, counting and encoding of text tables.

Nothing else in the library imports this subpackage.
"""

import importlib
import sys

from pyspark import cloudpickle

#: Modules whose functions run inside Python workers.  They are pickled by
#: value, so executors need no copy of this repository on their path.
_WORKER_MODULES = (
    "common",
    "line_cleaning",
    "token_rollups",
    "signature_join",
    "bayes_minhash",
    "source_divergence",
    "pu_quality",
    "token_frames",
    "piece_codec",
)

for _name in _WORKER_MODULES:
    importlib.import_module(f"{__name__}.{_name}")
    cloudpickle.register_pickle_by_value(sys.modules[f"{__name__}.{_name}"])
