import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cohort_spark.session import build_session

    s = build_session(cpus="*", shuffle_partitions=8, app="cohort_tests", driver_memory="8g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from cohort_spark.sources.tables import DRIVER_TABLES

    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con
