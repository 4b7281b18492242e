import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlynx.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    yield session
    session.stop()


def rows_by(df, *keys):
    """Collected rows keyed by the given columns."""
    out = {}
    for r in df.collect():
        k = tuple(r[x] for x in keys)
        assert k not in out
        out[k if len(keys) > 1 else k[0]] = r
    return out
