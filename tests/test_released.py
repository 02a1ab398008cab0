"""The driver's JVM gives freed memory back to the system."""

from __future__ import annotations

import sys

import pytest

from graphloom.shared import released


@pytest.mark.skipif(sys.platform != "linux", reason="trims glibc's memory")
def test_released(spark):
    assert released(spark)
