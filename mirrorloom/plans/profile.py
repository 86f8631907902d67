"""Counters of scans, gathered while their results are written: no second pass, nothing collected but the sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import detect as D
from ..params import ScanParams


class ScanProfile:
    """Volume counters of scans: centre-spacer pairs looked at and bases compared, of the last scan and of all.

    Each scan's sums arrive with the first action on its result (``pyspark.sql.Observation``).  They do not depend on how
    the records are cut into chunks.
    """

    def __init__(self) -> None:
        self._scans: list[Observation] = []

    def detect(self, records: DataFrame, p: ScanParams | None = None, size: int = D.CHUNK) -> DataFrame:
        """:func:`plans.scan.detect_candidates` under observation."""
        p = p or ScanParams()
        seen = Observation()
        raw = D.counted_candidates(D.chunked(records, p, size), p)
        raw = raw.observe(seen, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in D.COUNTERS])
        self._scans.append(seen)
        return D.materialise(raw.where("start is not null"))

    def info(self) -> dict[str, int]:
        """Counters of the last scan, totals and the number of scans; waits for the first action on each."""
        got = [s.get for s in self._scans]
        last = got[-1] if got else dict.fromkeys(D.COUNTERS, 0)
        return {c: last[c] for c in D.COUNTERS} | {f"total_{c}": sum(g[c] for g in got) for c in D.COUNTERS} | {"scans_completed": len(got)}

    def reset(self) -> None:
        self._scans = []
