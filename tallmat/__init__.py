"""Low-rank analysis of large tables on PySpark.

A tall matrix is a DataFrame, either one row per matrix row (`TallMatrix`) or one
row per stored entry (`CooMatrix`). Factorizations take such frames and give
DataFrames back.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tallmat.frames import CooMatrix, TallMatrix  # noqa: E402
from tallmat.operators.cx import CxScores, cx_scores  # noqa: E402
from tallmat.operators.nmf import NmfModel, nmf  # noqa: E402
from tallmat.operators.pca import PcaModel, pca  # noqa: E402

__all__ = [
    "CooMatrix",
    "CxScores",
    "NmfModel",
    "PcaModel",
    "TallMatrix",
    "cx_scores",
    "nmf",
    "pca",
]
