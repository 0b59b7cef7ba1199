import os
import sys
from pathlib import Path

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from docloom.session import local

    session = local(4, "4g", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
