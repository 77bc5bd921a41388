import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallmat.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """A local matrix as a TallMatrix spread over the given number of partitions."""
    import numpy as np

    from tallmat.operators.products import local_rows

    def build(x, parts=3):
        a = local_rows(spark, np.asarray(x, dtype=float))
        a.df = a.df.repartition(parts)
        return a

    return build


@pytest.fixture(scope="session")
def make_coo(spark):
    import numpy as np

    from tallmat import CooMatrix

    def build(x):
        x = np.asarray(x, dtype=float)
        rows, cols = np.nonzero(x)
        data = [(int(i), int(j), float(x[i, j])) for i, j in zip(rows, cols)]
        df = spark.createDataFrame(data, "row_id BIGINT, col_id BIGINT, val DOUBLE")
        return CooMatrix(df, x.shape[1])

    return build
