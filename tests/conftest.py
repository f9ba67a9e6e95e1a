import os
import sys

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # threaded LU can hang in a process that forks
os.environ.setdefault("OMP_NUM_THREADS", "1")

import pytest  # noqa: E402

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from platewise.session import local_session

    s = local_session("*", app="platewise-tests", shuffle_partitions=8)
    yield s
    s.stop()
