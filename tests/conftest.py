import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from small_site import PAGES, SITE  # noqa: E402

from pageloom.session import local_session  # noqa: E402
from pageloom.sources.snapshots import PAGES_SCHEMA, SEEDS_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def site_pages(spark):
    rows = [(i, SITE + path, html) for i, (path, html) in enumerate(PAGES.items())]
    return spark.createDataFrame(rows, PAGES_SCHEMA).cache()


@pytest.fixture(scope="session")
def site_seeds(spark):
    return spark.createDataFrame([("c", SITE + "docs/")], SEEDS_SCHEMA).cache()
