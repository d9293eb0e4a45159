"""python -m oligoframe.tools.random_sequences --count N --lengths L...: a list of random sequences to try validation on."""

from __future__ import annotations

import argparse
from pathlib import Path

from ..cli import session, write_lines
from ..sources.random import random_list


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser()
    p.add_argument("--count", type=int, required=True)
    p.add_argument("--lengths", type=int, nargs="+", required=True)
    p.add_argument("--output")
    p.add_argument("--seed", default="0")
    a = p.parse_args(argv)
    rows = random_list(session(None), a.count, a.lengths, a.seed)
    path = Path(a.output or f"test/{a.count}_random_{min(a.lengths)}to{max(a.lengths)}bp_sequences.txt")
    path.parent.mkdir(parents=True, exist_ok=True)
    write_lines(rows.orderBy("id").select("seq"), path)
    print(path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
