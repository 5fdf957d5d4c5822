"""A writer killed at any moment leaves every acknowledged batch, and whole batches only."""

import os
import signal
import subprocess
import sys

from tidelog.plans.table import KvTable, Options

WRITER = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from tidelog.plans.table import KvTable, Options
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
table = KvTable(spark, sys.argv[2], "string", "string", Options(bloom=False, fanout=2))
for n in range(1000):
    base = n * 10
    table.append(spark.createDataFrame([(f"key{base + i:012d}", base + i + 1, 1, f"val-{base + i}") for i in range(10)], "key string, seq long, tag int, value string"))
    if n % 3 == 2:
        table.flush()
    print("ack", n, flush=True)
"""


def test_killed_writer(spark, tmp_path):
    root, repo = str(tmp_path / "t"), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    child = subprocess.Popen([sys.executable, "-c", WRITER, repo, root], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, start_new_session=True)
    acked = -1
    try:
        for line in child.stdout:
            if line.startswith("ack"):
                acked = int(line.split()[1])
                if acked >= 8:
                    break
    finally:
        os.killpg(child.pid, signal.SIGKILL)
        child.wait()
    table = KvTable(spark, root, "string", "string", Options(bloom=False, fanout=2))
    rows = [(r.key, r.value) for r in table.scan().collect()]
    assert acked == 8 and len(rows) >= 90 and len(rows) % 10 == 0
    assert rows == [(f"key{i:012d}", f"val-{i}") for i in range(len(rows))]
    table.put("later", "x")
    table.flush()
    assert table.get("later") == "x" and table.scan().count() == len(rows) + 1
