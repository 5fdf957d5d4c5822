"""The bulk workloads fill, flush, read and scan a table, and report."""

import pytest

from tidelog.plans import workloads as W
from tidelog.plans.table import Durability, KvTable


@pytest.mark.parametrize("workload", W.WORKLOADS)
def test_phases(spark, tmp_path, workload):
    c = W.Config(workload, Durability.GROUP_COMMIT, keys=500, concurrency=2, batches=3)
    rows = W.run(spark, str(tmp_path / "t"), c).collect()
    assert [r.phase for r in rows] == ([workload] if workload.startswith("fill") else ["fill", workload])
    assert rows[0].ops == 500 and all(r.throughput > 0 and r.min_us <= r.p50_us <= r.p99_us <= r.max_us for r in rows)
    table = KvTable(spark, str(tmp_path / "t"))
    assert table.scan(ordered=False).count() == 500 and len(table.get((7).to_bytes(16, "big"))) == 100


def test_command_line(spark, tmp_path, capsys):
    W.main(["fill-seq", "--keys", "40", "--batches", "2", "--durability", "always", "--dir", str(tmp_path / "t"), "--seed", "0x10"])
    assert "fill-seq" in capsys.readouterr().out


def test_report_of_nothing(spark):
    r = W.report(spark, "scan", W.Config(), 0, 0.0, []).first()
    assert r.throughput == 0 and r.p99_us == 0 and r.mean_us == 0
    assert [W.scan_window(n) for n in (0, 50, 5000, 10**7)] == [1, 1, 50, 1000]
