import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lagscope.session import build_session, checkpoint_dir

    s = build_session(master="local[4]", shuffle_partitions=8, app="lagscope-tests")
    checkpoint_dir(s)
    yield s


def rows(df, *cols):
    """Collect selected columns as a list of tuples (ordered as returned)."""
    return [tuple(r) for r in df.select(*cols).collect()] if cols else [tuple(r) for r in df.collect()]


def approx_list(actual, expected, tol=1e-9):
    assert len(actual) == len(expected), (actual, expected)
    for a, e in zip(actual, expected):
        if e is None:
            assert a is None, (actual, expected)
        else:
            assert a is not None and abs(a - e) <= tol, (actual, expected)
