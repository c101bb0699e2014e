"""What tables leave in the driver."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from sunstack.llm import scratch


def test_a_table_gives_native_memory_back(spark):
    """Blocks that are free but stand below one in use stay with the JVM until the heap is trimmed."""
    if not scratch.give_back(spark):
        pytest.skip("this JVM can't trim its native heap")
    jvm = spark.sparkContext._jvm
    pid, unsafe = jvm.java.lang.ProcessHandle.current().pid(), jvm.org.apache.spark.unsafe.Platform

    def held() -> int:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) // 1024

    blocks = [unsafe.allocateMemory(100_000) for _ in range(2500)]
    for at in blocks:
        unsafe.setMemory(at, 1, 100_000)
    for at in blocks[:-1]:
        unsafe.freeMemory(at)
    before = held()
    df = scratch.table(spark.range(10).toDF("x"), "small")
    after = held()
    unsafe.freeMemory(blocks[-1])
    assert df.count() == 10 and before - after > 120
