"""Run ledger: which (job, as_of) runs are due, claimed, done or failed (T5).

Jobs run on a grid of ``as_of`` points (drift every 5 minutes, scoring every
minute, training once a day).  The ledger holds no clock and starts nothing:
any caller asks for the points that are due and runs them.  Each point is
claimed by creating a file that only one caller can create, and completed by
another, so concurrent callers share the work and a caller that dies leaves a
claim that expires.  Missed points are simply still due (backfill).

Layout: ``{root}/{job}/{as_of}/claim-0001.json``, ``failed-0001.json``,
``done.json``.  A run repeated after a crash must replace its own output; the
result tables do (``replace`` by partition, newest row per key, one row per
key and ``computed_at`` in histories).
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..windows import as_of_value

STAMP = "%Y%m%dT%H%M%S"
RUNS = "job string, as_of timestamp_ntz, status string, attempts int, error string"


def grid(start, end, step_seconds: int) -> list[dt.datetime]:
    """Points start, start + step, ... not after ``end``."""
    lo, hi, out = as_of_value(start), as_of_value(end), []
    while lo <= hi:
        out.append(lo)
        lo += dt.timedelta(seconds=step_seconds)
    return out


class RunLedger:
    def __init__(self, spark: SparkSession, root: str, lease_seconds: int = 3600):
        self.spark, self.root, self.lease = spark, root.rstrip("/"), lease_seconds
        self.me = uuid.uuid4().hex

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _create(self, job: str, stamp: str, name: str, body: dict) -> bool:
        """Create the file; False if it is there already."""
        from py4j.protocol import Py4JJavaError
        try:
            out = self._fs().create(self._path(job, stamp, name), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        return True

    def _files(self, job: str, stamp: str) -> dict[str, int]:
        folder, fs = self._path(job, stamp), self._fs()
        if not fs.exists(folder):
            return {}
        return {f.getPath().getName(): f.getModificationTime() for f in fs.listStatus(folder) if not f.getPath().getName().startswith(".")}

    def done(self, job: str, as_of) -> bool:
        return "done.json" in self._files(job, as_of_value(as_of).strftime(STAMP))

    def due(self, job: str, points: Iterable) -> list[dt.datetime]:
        """The points without a completed run, oldest first."""
        return sorted(p for p in map(as_of_value, points) if not self.done(job, p))

    def claim(self, job: str, as_of, now_ms: int | None = None) -> str | None:
        """The attempt's number, or None if the point is done or another
        caller's claim has neither failed nor expired."""
        stamp = as_of_value(as_of).strftime(STAMP)
        files = self._files(job, stamp)
        if "done.json" in files:
            return None
        claims = sorted(n for n in files if n.startswith("claim-"))
        if claims:
            last = claims[-1][6:10]
            now = now_ms if now_ms is not None else int(dt.datetime.now().timestamp() * 1000)
            if f"failed-{last}.json" not in files and now - files[claims[-1]] < self.lease * 1000:
                return None
        n = f"{len(claims) + 1:04d}"
        return n if self._create(job, stamp, f"claim-{n}.json", {"by": self.me}) else None

    def run(self, job: str, points: Iterable, work: Callable[[dt.datetime], None]) -> list[dt.datetime]:
        """Run the due points this caller can claim; returns those completed.
        A failing point is recorded and does not keep the others from running."""
        out = []
        for p in self.due(job, points):
            n, stamp = self.claim(job, p), p.strftime(STAMP)
            if n is None:
                continue
            try:
                work(p)
            except Exception as e:          # recorded in the ledger, visible in runs() and due again
                self._create(job, stamp, f"failed-{n}.json", {"by": self.me, "error": f"{type(e).__name__}: {e}"[:2000]})
                continue
            if self._create(job, stamp, "done.json", {"by": self.me, "attempt": n}):
                out.append(p)
        return out

    def runs(self, job: str) -> DataFrame:
        """(job, as_of, status, attempts, error of the last failed attempt), one row a point ever claimed."""
        folder, fs, rows = self._path(job), self._fs(), []
        for f in fs.listStatus(folder) if fs.exists(folder) else ():
            stamp = f.getPath().getName()
            files = self._files(job, stamp)
            failed = sorted(n for n in files if n.startswith("failed-"))
            claims = sum(n.startswith("claim-") for n in files)
            status = "done" if "done.json" in files else "failed" if len(failed) == claims else "claimed"
            error = None
            if failed:
                stream = fs.open(self._path(job, stamp, failed[-1]))
                error = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["error"]
                stream.close()
            rows.append((job, dt.datetime.strptime(stamp, STAMP), status, claims, error))
        return self.spark.createDataFrame(rows, RUNS)
