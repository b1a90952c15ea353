"""Progress of long work, told to a callback: of streams by a listener, of anything else stage by stage."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


@dataclass
class Progress:
    """Where a piece of work stands: ``done`` of ``total`` (null where unknown), and a word on it."""

    work: str
    done: int
    total: int | None = None
    note: str = ""


class Listener(StreamingQueryListener):
    """Tells each micro-batch of the session's streams as ``Progress``; rows add up over the batches of a stream."""

    def __init__(self, tell: Callable[[Progress], None]):
        self.tell, self.rows = tell, {}

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.runId)] = 0
        self.tell(Progress(event.name or str(event.id), 0, note="started"))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows[str(p.runId)] = self.rows.get(str(p.runId), 0) + p.numInputRows
        self.tell(Progress(p.name or str(p.id), self.rows[str(p.runId)], note=f"batch {p.batchId}"))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell(Progress(str(event.id), self.rows.pop(str(event.runId), 0), note="failed" if event.exception else "done"))


def watch(spark: SparkSession, tell: Callable[[Progress], None]) -> Listener:
    listener = Listener(tell)
    spark.streams.addListener(listener)
    return listener


def staged(work: str, stages: Iterable[tuple[str, Callable[[], DataFrame | None]]], tell: Callable[[Progress], None]) -> None:
    """Runs named stages in order and tells before and after each; an error is told and raised."""
    stages = list(stages)
    for i, (name, run) in enumerate(stages):
        tell(Progress(work, i, len(stages), name))
        try:
            run()
        except Exception as problem:
            tell(Progress(work, i, len(stages), f"{name} failed: {problem}"))
            raise
    tell(Progress(work, len(stages), len(stages), "done"))


def as_row(p: Progress) -> dict:
    return asdict(p)
