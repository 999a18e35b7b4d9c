"""A buffered writer: single rows, committed many at a time."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from ..session import Session


class BufferedWriter:
    """Collects rows of one table; commits when there are max_rows, about max_bytes, or the oldest is max_age seconds old.

    A timer looks after the age, so that rows are committed though none follow. It works in a session of its own; if its
    commit fails, the rows are still held and on_error is told, or, without one, the next add, flush or close raises the error.
    """

    def __init__(self, session: Session, table: str, max_rows: int = 10_000, max_bytes: int = 8 << 20, max_age: float = 5.0, upsert: bool = False, on_error: Callable[[Exception], None] | None = None) -> None:
        self.session, self.table, self.upsert, self.on_error = session.another(), table, upsert, on_error
        self.max_rows, self.max_bytes, self.max_age = max_rows, max_bytes, max_age
        self.rows: list[dict] = []
        self.bytes, self.since, self.closed = 0, 0.0, False
        self.lock, self.timer, self.error = threading.RLock(), None, None

    def add(self, row: dict) -> None:
        with self.lock:
            self._check()
            if self.closed:
                raise ValueError("the writer is closed")
            if not self.rows:
                self.since = time.monotonic()
                self._wait()
            self.rows.append(row)
            self.bytes += sum(len(v) if isinstance(v, str) else 8 for v in row.values())
            if len(self.rows) >= self.max_rows or self.bytes >= self.max_bytes or time.monotonic() - self.since >= self.max_age:
                self.flush()

    def _check(self) -> None:
        error, self.error = self.error, None
        if error:
            raise error

    def _wait(self) -> None:
        self._stop()
        self.timer = threading.Timer(self.max_age, self._aged)
        self.timer.daemon = True
        self.timer.start()

    def _stop(self) -> None:
        if self.timer:
            self.timer.cancel()
        self.timer = None

    def _aged(self) -> None:
        with self.lock:
            if self.closed or not self.rows:
                return
            try:
                self._commit()
            except Exception as e:  # noqa: BLE001  told to the caller
                if self.on_error:
                    self.on_error(e)
                else:
                    self.error = e
                self._wait()

    def _commit(self) -> int:
        if not self.rows:
            return 0
        (self.session.upsert_rows if self.upsert else self.session.insert_rows)(self.table, self.rows)
        n = len(self.rows)
        self.discard()
        return n

    def flush(self) -> int:
        """Commits what is held; if that fails the rows are still held."""
        with self.lock:
            self._check()
            return self._commit()

    def discard(self) -> None:
        with self.lock:
            self._stop()
            self.rows, self.bytes = [], 0

    def close(self) -> None:
        with self.lock:
            self.flush()
            self.closed = True

    def __enter__(self) -> BufferedWriter:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        self.discard() if kind else self.flush()
        self.closed = True
