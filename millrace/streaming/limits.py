"""How many merges and start-up checks run at once in this process, and the check of the spill folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..errors import CapacityError, ConfigError

LEAST_SPILL = 1_000_000


class Gate:
    """A semaphore that knows how many are inside and how long they waited. None: no limit."""

    def __init__(self, most: int | None = None):
        if most is not None and most < 1:
            raise ConfigError("a limit of 0 would never let anything run")
        self._slots = threading.Semaphore(most) if most else None
        self._lock = threading.Lock()
        self.inside = 0

    @contextmanager
    def entered(self) -> Iterator[float]:
        """Gives the seconds spent waiting."""
        began = time.monotonic()
        if self._slots:
            self._slots.acquire()
        with self._lock:
            self.inside += 1
        try:
            yield time.monotonic() - began
        finally:
            with self._lock:
                self.inside -= 1
            if self._slots:
                self._slots.release()


def check_spill(folder: str | None, most_bytes: int | None) -> None:
    """Refuses limits that could never work, and a folder that can't be written."""
    if most_bytes is not None and most_bytes < LEAST_SPILL:
        raise ConfigError(f"{most_bytes} bytes to spill into are too few; leave the setting out for no limit")
    if folder:
        probe = os.path.join(folder, f".millrace-{uuid.uuid4().hex}")
        try:
            os.makedirs(folder, exist_ok=True)
            with open(probe, "wb") as f:
                f.write(b"probe")
            os.unlink(probe)
        except OSError as e:
            raise ConfigError(f"{folder} can't be spilled into: {e}") from None


def spilled(spark: SparkSession, folder: str | None, most_bytes: int | None) -> dict[str, int]:
    """Process series about spilling: bytes over the stages that Spark remembers, the limit that is set, and the room there is."""
    memory = disk = 0
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    for k in range(stages.size()):
        memory, disk = memory + stages.apply(k).memoryBytesSpilled(), disk + stages.apply(k).diskBytesSpilled()
    place = folder or spark.conf.get("spark.local.dir", None) or tempfile.gettempdir()
    free = shutil.disk_usage(place).free if os.path.isdir(place) else 0
    return {"spill_memory_bytes": memory, "spill_disk_bytes": disk, "spill_limit_bytes": most_bytes or 0, "spill_free_bytes": free}


def is_capacity(error: BaseException) -> bool:
    """Whether memory or disk ran out, so that trying again soon won't help."""
    text = str(error)
    return isinstance(error, CapacityError) or any(x in text for x in ("No space left on device", "OutOfMemoryError", "Disk quota exceeded", "UNABLE_TO_ACQUIRE_MEMORY", "SparkOutOfMemoryError"))

