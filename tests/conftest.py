import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
FIXTURES = os.path.join(os.path.dirname(__file__), "fixtures")


@pytest.fixture(scope="session")
def spark():
    from sluice.session import ensure_checkpoint_dir, get_spark
    scratch = tempfile.mkdtemp(prefix="sluice-test-")
    s = get_spark(master="local[4]", shuffle_partitions=8, conf={
        "spark.sql.warehouse.dir": os.path.join(scratch, "warehouse"),
        "spark.driver.memory": "4g",
    })
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def db(spark, request):
    """A fresh database per test, dropped afterwards."""
    name = "t_" + "".join(ch if ch.isalnum() else "_" for ch in request.node.name)[:60].lower()
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    spark.sql(f"CREATE DATABASE {name}")
    yield name
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
