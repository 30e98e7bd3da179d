import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tramline.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, partitions=4)
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return SF
