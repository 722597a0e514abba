import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from reliaspan.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests")


@pytest.fixture
def rng():
    return np.random.default_rng(42)


@pytest.fixture(scope="session")
def frames_of(spark):
    """Recordings {subject: array[time, channels]} as frames."""

    def build(recordings):
        rows = [
            (s, t, list(range(x.shape[1])), [float(v) for v in x[t]]) for s, x in recordings.items() for t in range(len(x))
        ]
        return spark.createDataFrame(rows, "subject_id long, t int, channels array<int>, x array<double>")

    return build
