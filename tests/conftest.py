import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ramify.session import build_session

    shared = tmp_path_factory.mktemp("checkpoints")
    session = build_session(
        "tests", master="local[8]", shuffle_partitions=8, extra={"spark.checkpoint.dir": str(shared)}
    )
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collected rows as plain tuples, sorted."""

    def collect(df, *cols):
        picked = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return collect
