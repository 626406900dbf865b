"""Notices of what streams did, sent by a function of the caller's."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)
BEAT_SECONDS = 30.0


def push(send: Callable[[str, str], None] | None, title: str, message: str) -> bool:
    """Sends a notice; none without a function. Whatever the function raises is logged and ends there, as a failed notice must not stop a run."""
    if send is None:
        return False
    try:
        send(title, message)
    except Exception as e:
        log.warning("notice not sent: %s", e)
        return False
    return True


def push_changes(send: Callable[[str, str], None] | None, notes: DataFrame) -> int:
    """Sends the notes of a run, one row a source and kind of change; returns how many were sent."""
    return sum(push(send, r.note.split(":\n", 1)[0], r.note) for r in notes.collect())


@contextmanager
def beating(send: Callable[[str, str], None] | None, title: str, message: str, seconds: float = BEAT_SECONDS) -> Iterator[None]:
    """While its body runs, a notice after every so many seconds, from a timer beside it. The timer ends with the body, also by an exception, and no notice follows."""
    if send is None:
        yield
        return
    over = threading.Event()

    def beat() -> None:
        while not over.wait(seconds):
            push(send, title, message)

    timer = threading.Thread(target=beat, name="heartbeat", daemon=True)
    timer.start()
    try:
        yield
    finally:
        over.set()
        timer.join()


class Heartbeat(StreamingQueryListener):
    """A notice for each micro-batch with input, for idle triggers, and for the end of a query."""

    def __init__(self, send: Callable[[str, str], None] | None):
        self.send = send

    def onQueryStarted(self, event) -> None:  # noqa: N802
        push(self.send, "started", str(event.name or event.id))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        push(self.send, "running", f"batch {event.progress.batchId}: {event.progress.numInputRows} rows")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        push(self.send, "idle", str(event.id))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        push(self.send, "failed" if event.exception else "ended", str(event.exception or event.id))
