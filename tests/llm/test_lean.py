"""Python workers hand back what their tasks freed."""

import re
from pathlib import Path

from ledgerlark.llm.common import lean


def _held() -> int:
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10


def test_freed_memory_goes_back():
    seen = []

    def work(batches):
        blocks = [bytearray(b"x" * 100_000) for _ in range(3000)]
        pins = blocks[::100]  # the heap's end stays in use, so that nothing behind it goes back by itself
        yield from batches
        del blocks
        seen.append((pins, _held()))

    assert list(lean(work)(iter([1, 2]))) == [1, 2]
    assert _held() < seen[0][1] - 150
