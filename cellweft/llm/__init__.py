"""Operators that prepare training text.

Most of them work on signature rows ``(lineage, genes)``: the raw cells of a signature atlas, ``lineage`` naming the row and
``genes`` holding its text as written, before it is split into gene names. Personal data and licences are looked for in manifest rows
``(sample_id, filepath, ...)``, and mixing works on ``cells(dataset_id, cell_id, total, weight)``.
"""

import sys

from pyspark import cloudpickle

# Tasks get these functions by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
