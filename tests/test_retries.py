"""Tasks that fail once and run again must not change any result."""

import os
import subprocess
import sys

from conftest import ROOT

SCRIPT = """
import numpy as np
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
import narrowmat as nm
from narrowmat.plans.reduce import matrix_rows

spark = (
    SparkSession.builder.master("local[4,3]")
    .config("spark.driver.host", "127.0.0.1")
    .config("spark.driver.bindAddress", "127.0.0.1")
    .config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "8")
    .config("spark.checkpoint.dir", "shared")
    .getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")


def lost():
    task = TaskContext.get()
    return task.attemptNumber() == 0 and task.partitionId() % 2 == 0


def features(batch):
    if lost():
        raise RuntimeError("lost")
    return matrix_rows(batch)


class Fragile(nm.QRBlocks):
    def result(self):
        found = super().result()
        if lost():
            raise RuntimeError("lost")
        return found


def through(batches):
    for batch in batches:
        if lost():
            raise RuntimeError("lost")
        yield batch


a = np.random.default_rng(0).standard_normal((2000, 5))
rows = [(i, [float(x) for x in row]) for i, row in enumerate(a)]
m = spark.createDataFrame(rows, "key long, row array<double>").repartition(6)
want = a.T @ a
for schedule in (None, "4,2,1", "s5,3,1"):
    r = nm.collect_factor(nm.tsqr(m, schedule=schedule, features=features))
    assert np.allclose(r.T @ r, want)
    r = nm.collect_factor(nm.block_reduce(m, Fragile, schedule))
    assert np.allclose(r.T @ r, want)
mixed = nm.mix_rows(m, 20, 2, seed=1)
again = nm.mix_rows(m.mapInArrow(through, m.schema), 20, 2, seed=1).mapInArrow(through, m.schema)
assert sorted(mixed.collect()) == sorted(again.collect())
tree = nm.DirectQR(m.mapInArrow(through, m.schema))
q = {x.key: x.row for x in tree.times(np.eye(5)).mapInArrow(through, m.schema).collect()}
assert np.allclose(np.array([q[k] for k in range(2000)]) @ tree.r, a)
print("same results")
"""


def test_tasks_that_run_again(tmp_path):
    found = subprocess.run(
        [sys.executable, "-c", SCRIPT],
        env={**os.environ, "PYTHONPATH": ROOT},
        cwd=tmp_path,
        capture_output=True,
        text=True,
        timeout=300,
    )
    assert "same results" in found.stdout, found.stderr[-3000:]
