"""python -m oligoframe.tools.memory_benchmark COMMAND...: duration and peak memory of a command with all its processes."""

from __future__ import annotations

import subprocess
import sys
import time
from pathlib import Path


def _tree(pid: int) -> list[int]:
    found = [pid]
    for p in found:
        try:
            found += [int(x) for x in Path(f"/proc/{p}/task/{p}/children").read_text().split()]
        except OSError:
            continue
    return found


def _resident_mb(pid: int) -> float:
    total = 0.0
    for p in _tree(pid):
        try:
            total += next(int(x.split()[1]) for x in Path(f"/proc/{p}/status").read_text().splitlines() if x.startswith("VmRSS")) / 1024
        except (OSError, StopIteration):
            continue
    return total


def measure(command: list[str]) -> dict[str, float]:
    began, peak = time.time(), 0.0
    run = subprocess.Popen(command)
    while run.poll() is None:
        peak = max(peak, _resident_mb(run.pid))
        time.sleep(0.1)
    return {"seconds": time.time() - began, "peak_mb": peak, "exit": run.returncode}


if __name__ == "__main__":
    result = measure(sys.argv[1:])
    print(f"Duration: {result['seconds']:.1f} s, peak memory: {result['peak_mb']:.0f} MB, exit code {result['exit']}")
    sys.exit(int(result["exit"]))
