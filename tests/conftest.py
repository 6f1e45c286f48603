from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rankloom.session import clear_folders, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "rankloom-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    clear_folders(session)
    session.stop()
