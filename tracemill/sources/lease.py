"""One writer at a time, on storage that several machines share.

A lease is a file named by a number, made only if absent; the highest number is
the present one. It holds the owner and when it ends. Who wants it makes the
next number, unless the present one is still held. A number never comes back,
so it serves as a fence: a writer whose lease ran out and was taken over finds
a higher number when it checks, and its write is refused. Clocks of the
machines may differ by less than the margin that a holder keeps (a tenth of the
lease, by which it stops earlier than others take over).
"""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from tracemill.sources import files


class Held(RuntimeError):
    """Another writer has the lease."""


class Lost(RuntimeError):
    """The lease ran out or was taken over."""


class Lease:
    def __init__(self, spark: SparkSession, path: str, seconds: float = 600.0, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.path, self.seconds, self.clock = spark, path.rstrip("/"), seconds, clock
        self.owner = f"{socket.gethostname()}:{os.getpid()}:{uuid.uuid4().hex[:8]}"
        self.number = 0

    def _top(self) -> tuple[int, dict]:
        found = [x for x in files.names(self.spark, self.path) if x.isdigit()]
        return (int(found[-1]), json.loads(files.read(self.spark, f"{self.path}/{found[-1]}"))) if found else (0, {"until": 0, "owner": ""})

    def _text(self, until: float) -> str:
        return json.dumps({"owner": self.owner, "until": until})

    def acquire(self) -> Lease:
        number, held = self._top()
        if self.clock() < held["until"]:
            raise Held(f"{held['owner']} is writing already, as number {number}")
        if not files.create(self.spark, f"{self.path}/{number + 1:012d}", self._text(self.clock() + self.seconds)):
            raise Held(f"another writer was faster to number {number + 1}")
        self.number = number + 1
        if number:
            files.delete(self.spark, f"{self.path}/{number:012d}")
        return self

    def check(self) -> int:
        """The number to write under; raises Lost if it isn't the present one or is about to end."""
        number, held = self._top()
        if number != self.number or held["owner"] != self.owner:
            raise Lost(f"number {self.number} was followed by {number} ({held['owner']})")
        if self.clock() >= held["until"] - self.seconds / 10:
            raise Lost(f"number {self.number} has run out")
        return self.number

    def renew(self) -> None:
        self.check()
        files.replace(self.spark, f"{self.path}/{self.number:012d}", self._text(self.clock() + self.seconds))

    def release(self) -> None:
        """Ends the lease; its number stays, so the next one is higher."""
        number, held = self._top()
        if number == self.number and held["owner"] == self.owner:
            files.replace(self.spark, f"{self.path}/{number:012d}", self._text(0))

    def __enter__(self) -> Lease:
        return self.acquire()

    def __exit__(self, *_: object) -> None:
        self.release()
