"""What the Python tasks of the operators hold: batches are bounded by bytes, and a worker that Spark keeps gives a task's memory back."""

import pyarrow as pa

from stowage.llm import common as C


def tasks():
    """Two functions for tasks, defined here so that they are sent to the workers by value."""

    def held(batches):
        """(MB of this worker's own memory, most bytes of a batch)."""
        import re
        import time

        most = max((b.nbytes for b in batches), default=0)
        time.sleep(0.3)
        with open("/proc/self/smaps_rollup") as f:
            mb = int(re.search(r"Private_Dirty:\s+(\d+)", f.read())[1]) // 1024
        yield pa.RecordBatch.from_pydict({"mb": [mb], "most": [most]})

    def litter(batches):
        """Takes 200 MB in small strings and frees all but the last, below which the C library gives nothing back by itself."""
        import time

        for _ in batches:
            pass
        many = [bytes([i % 256]) * 50_000 for i in range(4000)]
        time.__dict__.setdefault("_pins", []).append(many[-1])
        del many
        time.sleep(0.3)
        yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int64())})

    return held, litter


def test_workers_give_back_what_a_task_took(spark):
    held, litter = tasks()
    most_held = lambda: max(r.mb for r in spark.range(0, 16, 1, 16).mapInArrow(held, "mb long, most long").collect())
    before = most_held()
    assert C.in_arrow(spark.range(0, 8, 1, 8), litter, "n long").count() == 8
    assert most_held() < before + 60


def test_batches_end_by_bytes(spark):
    rows = spark.range(0, 9000, 1, 1).selectExpr("repeat('x', 5000) as text")
    assert C.in_arrow(rows, tasks()[0], "mb long, most long").first().most < C.BATCH_BYTES + (1 << 20)
