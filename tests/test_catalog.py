"""Every registered query of the engine against its SQL."""

import os

import oracle
import pytest

from tidelog.plans import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    assert oracle.rows(catalog.queries()[name](spark, oracle.SF)) == oracle.expected(con, catalog.oracle_sql()[name])


def test_frame_bytes(spark):
    from tidelog.sources import wal

    for r in catalog.frame_crc(spark, oracle.SF).collect():
        ((_, _, _, payload, state),) = wal.frames(bytes.fromhex(r.frame))
        assert state == wal.CLEAN and wal.decode_record(payload)[1] == r.seq


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert [r.key for r in rows] == sorted(r.key for r in rows) and rows
    assert set(entry.oracle_sql()) <= set(entry.queries())
