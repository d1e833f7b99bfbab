"""Operators for preparing language-model training data.

One module per operator, each with a general interface; ``queries`` holds the
registered ``opN_*`` queries and their oracle SQL.  Nothing outside this
package imports it.

Functions that run in Python workers are sent by value, so a cluster needs no
copy of this package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
