"""Operators for training-data corpora over ``documents(doc_id, text, lang, source, n_chars)``.

Functions of this subpackage that run in Python workers are shipped by value, so executors need the public libraries
but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
