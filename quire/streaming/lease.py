"""One run at a time, across sessions: a lease in the shared folder, with expiry and a fencing token."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from .files import names, read_text, write_text


class Held(RuntimeError):
    """Another session holds the lease."""


class Lease:
    """The right to write to a folder. Tokens rise by one with every holder; a token is a file that is created once.

    An expired lease may be taken over, by the next token. Whoever holds an older token then fails in check(), which
    writers call before each commit; so a run that was thought dead can't write over its successor. Sessions' clocks
    may differ by less than a lease lasts. The store has to refuse to create a file that is there."""

    def __init__(self, spark: SparkSession, folder: str, owner: str, seconds: float = 60.0, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.owner, self.seconds, self.clock = spark, f"{folder}/lease", owner, seconds, clock
        last = self._last()
        if last:
            holder, until = self._read(last)
            if until > clock():
                raise Held(f"{holder} holds {folder} for another {until - clock():.0f} s")
        self.token = last + 1
        if not write_text(spark, self._file(self.token), self._text(seconds), overwrite=False):
            raise Held(f"another session has just taken {folder}")

    def _file(self, token: int) -> str:
        return f"{self.folder}/token-{token:012d}"

    def _text(self, seconds: float) -> str:
        return f"{self.clock() + seconds} {self.owner}"

    def _last(self) -> int:
        return max((int(n[6:]) for n in names(self.spark, self.folder) if n.startswith("token-")), default=0)

    def _read(self, token: int) -> tuple[str, float]:
        until, _, owner = (read_text(self.spark, self._file(token)) or "0 ").partition(" ")
        return owner, float(until or 0)

    def check(self) -> None:
        """Fails if another holder has come since; renews the lease otherwise."""
        if self._last() != self.token:
            raise Held(f"{self.owner} has lost {self.folder} to a later holder")
        write_text(self.spark, self._file(self.token), self._text(self.seconds))

    def release(self) -> None:
        if self._last() == self.token:
            write_text(self.spark, self._file(self.token), f"0 {self.owner}")

    def __enter__(self) -> Lease:
        return self

    def __exit__(self, *error) -> None:
        self.release()
