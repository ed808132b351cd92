"""Training-data operators: near duplicates, search, mixing, packing, filters.

Nothing outside this subpackage imports it.
"""

import os
import sys

from pyspark import cloudpickle

_root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
if _root != os.getcwd() and _root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    # Python workers can't import the package from there, so functions carry their code.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
