import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from kwhlens import get_session

    s = get_session(master="local[4]", shuffle_partitions=4)
    yield s


def rows(df, order=None):
    """Collect as a list of dicts, sorted for order-insensitive comparison."""
    out = [r.asDict() for r in df.collect()]
    key = order or sorted(df.columns)
    return sorted(out, key=lambda r: tuple((r[k] is None, str(r[k])) for k in key))
