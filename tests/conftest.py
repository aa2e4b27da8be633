import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "local[*]",
        app_name="tillspark-tests",
        shuffle_partitions=8,
        checkpoint_dir=tempfile.mkdtemp(prefix="tillspark-test-ckpt-"),
    )
    yield s


@pytest.fixture(scope="session")
def seed(spark):
    from seed_rows import seed_model

    return seed_model(spark)


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="tillspark-test-")
