"""Blocks of a fixed number of frames from a stream of runs of samples: what is left over waits in the session's state."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row

from ..operators.blocking import FRAMES
from . import ordering

OUT = "session STRING, block BIGINT, samples ARRAY<FLOAT>, late BOOLEAN"
RUNS = "session STRING, seq BIGINT, samples ARRAY<FLOAT>, ts_ms BIGINT"


def step(frames: int = FRAMES) -> ordering.Step:
    def run(value: tuple, session: str, rows: Iterable[Row]) -> tuple[tuple, list[Row]]:
        left, block, out = list(value[0]), value[1], []
        for r in rows:
            left += r.samples or []
        at = 0
        while len(left) - at >= frames:
            out.append(Row(session=session, block=block, samples=left[at : at + frames], late=False))
            at, block = at + frames, block + 1
        return (left[at:], block), out

    def late(session: str, r: Row) -> Row:
        return Row(session=session, block=None, samples=r.samples, late=True)

    return ordering.Step("samples ARRAY<FLOAT>, block BIGINT", ([], 0), run, late, OUT, "samples ARRAY<FLOAT>")


def packed(runs: DataFrame, frames: int = FRAMES, delay: str = "10 minutes", idle_ms: int | None = None) -> DataFrame:
    """Rows (session, block, samples, late) of a stream of runs (RUNS) that come in any order up to `delay` behind the latest
    time. A later run is `late`, has no block, and its frames are left out."""
    return ordering.in_order(runs, step(frames), delay, idle_ms)
