from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tillmark.session import local_session

    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session(cores=4, partitions=4, app="tests", **{"spark.checkpoint.dir": folder})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
