"""Telescope visits as a stream: one visit a micro-batch step, in order, each at most once.

A visit is registered, loads the objects of the chunks it touches, is matched, and commits or rolls
back. That it committed stands in the object table, in the same file as its rows, so a stream that
broke off anywhere skips the visits that are done and runs the others again. The visit log has what
is in flight or failed. Writers may share a table: a visit whose chunks another one changed meanwhile
is worked again from the changed table; visits of different chunks do not wait for each other.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from zonewise.sources.store import Files, VersionConflict, VersionedTable

#: Visits that may be in flight at once, and seconds a visit may take.
MAX_IN_FLIGHT, DEADLINE_SECONDS = 16, 600
#: How often a visit is worked while others change its chunks, and changes after which the table is written anew.
ATTEMPTS, MAX_DELTAS = 5, 16
REGISTERED, COMMITTED, FAILED = "registered", "committed", "failed"


class VisitError(RuntimeError):
    pass


@dataclass
class VisitLog:
    """The states of visits, in one small file that is replaced as a whole."""

    spark: SparkSession
    path: str

    def states(self) -> dict[int, str]:
        files = Files(self.spark)
        return {int(k): v for k, v in json.loads(files.read(self.path)).items()} if files.exists(self.path) else {}

    def _set(self, visit_id: int, state: str | None) -> None:
        states = self.states()
        states.pop(visit_id, None)
        if state:
            states[visit_id] = state
        Files(self.spark).replace(self.path, json.dumps(states))

    def register(self, visit_id: int) -> None:
        """A visit that is known, or one too many in flight, is an error."""
        states = self.states()
        if visit_id in states:
            raise VisitError(f"visit {visit_id} is already known")
        if sum(s == REGISTERED for s in states.values()) >= MAX_IN_FLIGHT:
            raise VisitError("too many visits are in flight")
        self._set(visit_id, REGISTERED)

    def is_in_flight(self, visit_id: int) -> bool:
        return self.states().get(visit_id) == REGISTERED

    def fail(self, visit_id: int) -> None:
        """Marks a visit as failed; nothing happens for one that isn't known."""
        if visit_id in self.states():
            self._set(visit_id, FAILED)

    def end(self, visit_id: int, rollback: bool = False) -> bool:
        """Whether the visit committed: it does unless it failed or is rolled back."""
        if visit_id not in self.states():
            raise VisitError(f"visit {visit_id} is not known")
        done = self.is_in_flight(visit_id) and not rollback
        self._set(visit_id, COMMITTED if done else FAILED)
        return done

    def forget(self, visit_id: int) -> None:
        self._set(visit_id, None)


def run_visit(log: VisitLog, table: VersionedTable, visit: Row, work: Callable[[Row], str], deadline: float = DEADLINE_SECONDS) -> bool:
    """One visit from registration to its end; False if it was in the table already.

    work returns a staged version of ``table``, which is published only if all went well in time.
    """
    if visit.visit_id in table.visits():
        # perhaps the run that published it broke off before it could say so
        log.forget(visit.visit_id)
        return False
    # left behind by a run that broke off: the table says that nothing of it was published
    log.forget(visit.visit_id)
    log.register(visit.visit_id)
    began, staged = time.monotonic(), None
    try:
        for attempt in range(ATTEMPTS):
            staged = work(visit)
            if time.monotonic() - began > deadline:
                raise VisitError(f"visit {visit.visit_id} took more than {deadline} s")
            try:
                table.commit(staged, visit.visit_id)
                break
            except VersionConflict:
                if attempt + 1 == ATTEMPTS:
                    raise
                table.rollback(staged)
                staged = None
    except Exception:
        log.fail(visit.visit_id)
        if staged:
            table.rollback(staged)
        raise
    return log.end(visit.visit_id)


def stream_visits(visits: DataFrame, log: VisitLog, table: VersionedTable, work: Callable[[Row], str], checkpoint: str):
    """Runs a stream of visits (visit_id, ...) that is there now to its end, in the order of their ids within a batch.

    A batch holds visits, which are few; each is a Spark job of its own over the tables. The table is
    written anew when it has MAX_DELTAS changes. Returns the finished query.
    """

    def batch(rows: DataFrame, _: int) -> None:
        for visit in rows.orderBy("visit_id").toLocalIterator():
            run_visit(log, table, visit, work)
            if table.deltas() >= MAX_DELTAS:
                try:
                    table.compact()
                except VersionConflict:
                    # another writer was first: the next visit tries again
                    pass

    query = visits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
