import os
import sys

import pytest
from hypothesis import settings

# Property tests draw the same examples on every run (reproducible failures).
settings.register_profile("repeatable", derandomize=True, print_blob=True)
settings.load_profile("repeatable")

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from packetlake.session import build_session, checkpoint_dir

    s = build_session(master="local[*]", app="packetlake-tests", shuffle_partitions=8,
                      spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def packets01(spark):
    from packetlake.sources import fixtures

    df = fixtures.packets(spark, SF01).cache()
    df.count()
    yield df
    df.unpersist()
