"""Runs many pipelines beside each other, each tried again by itself after a failure."""

from __future__ import annotations

import hashlib
import logging
import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..errors import MillraceError, SourceFileVacuumed
from ..operators.publish import Publisher, WebPubSub
from ..sources.stream import parse_bytes
from .config import Config, PublishConfig, Resolution, Resolved
from .limits import Gate, is_capacity, spilled
from .metrics import Metrics, text
from .pipeline import Pipeline

log = logging.getLogger(__name__)

FIRST, MOST, SPREAD = 1.0, 300.0, 0.25


def backoff(failures: int, name: str) -> float:
    """Seconds until the next try: doubling, and 25 % more or less, always the same for one name and number."""
    base = min(MOST, FIRST * 2 ** max(0, min(failures, 30) - 1))
    part = int.from_bytes(hashlib.blake2b(f"{name}|{failures}".encode(), digest_size=4).digest()) / 0xFFFFFFFF
    return base * (1 - SPREAD + 2 * SPREAD * part)


def publisher_for(settings: Resolved, publish: PublishConfig | None) -> Publisher | None:
    if settings.publish is None or publish is None or not publish.connection_string:
        return None
    sender = WebPubSub.from_connection_string(publish.connection_string, publish.hub, publish.message_ttl_secs, publish.timeout_secs)
    return Publisher(sender, settings.name, settings.app_id, settings.publish.model, settings.publish.group, settings.publish.sql, publish.max_payload_bytes)


class Supervisor:
    def __init__(self, spark: SparkSession, config: Config, resolution: Resolution, publish: bool = True, make: Callable[..., Pipeline] = Pipeline, locate: Callable[[Resolved], Resolved] | None = None):
        self.spark, self.config, self.resolution, self.make, self.locate = spark, config, resolution, make, locate
        self.publish = config.publish if publish else None
        self.stopping = threading.Event()
        self.merges, self.preflights = Gate(config.defaults.max_concurrent_upsert_merges), Gate(config.defaults.max_concurrent_upsert_preflights)
        self.metrics = {r.name: Metrics(r.name) for r in resolution.pipelines}
        for name in resolution.rejected:
            self.metrics[name] = Metrics(name)
            self.metrics[name].set(pipeline_config_valid=0)

    def page(self) -> str:
        d = self.config.defaults
        spill = spilled(self.spark, d.temp_directory, parse_bytes(d.max_temp_directory_size) if d.max_temp_directory_size else None)
        return text(list(self.metrics.values()), {"merges_in_flight": self.merges.inside, "preflights_in_flight": self.preflights.inside} | spill)

    def _open(self, settings: Resolved) -> Pipeline:
        publisher = publisher_for(settings, self.publish)
        self.metrics[settings.name].set(publish_configured=int(publisher is not None))
        return self.make(self.spark, settings, publisher=publisher, metrics=self.metrics[settings.name], merges=self.merges, preflights=self.preflights)

    def drive(self, settings: Resolved, once: bool) -> BaseException | None:
        """Until stopped; with once until the source has no more, or the first failure, which is returned."""
        failures, pipeline, own = 0, None, self.metrics[settings.name]
        # jobs of pipelines that run beside each other share the executors fairly, if spark.scheduler.mode is FAIR
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", settings.name)
        while not self.stopping.is_set():
            try:
                if self.locate:
                    now = self.locate(settings)
                    if now != settings:
                        settings, pipeline = now, None
                if pipeline is None:
                    pipeline = self._open(settings)
                own.set(pipeline_up=1)
                outcome = pipeline.step()
                if outcome.kind == "progressed":
                    failures = 0
                    own.set(source_file_vacuumed=0, capacity_exhausted=0)
                elif outcome.kind == "caught_up":
                    failures = 0
                    if once:
                        return None
                    self.stopping.wait(settings.allowed_latency_secs)
            except Exception as e:
                own.add(errors=1)
                own.set(pipeline_up=0, source_file_vacuumed=int(isinstance(e, SourceFileVacuumed)), capacity_exhausted=int(is_capacity(e)))
                if once:
                    return e
                failures += 1
                wait = MOST if is_capacity(e) else backoff(failures, settings.name)
                log.error("%s failed, is tried again in %.0f s: %s", settings.name, wait, e if isinstance(e, MillraceError) else repr(e))
                pipeline = None
                own.add(pipeline_restarts=1)
                self.stopping.wait(wait)
        return None

    def run(self, once: bool = False) -> dict[str, BaseException]:
        """The failures by name; there are none unless once."""
        failed: dict[str, BaseException] = {}

        def one(r: Resolved) -> None:
            error = self.drive(r, once)
            if error is not None:
                failed[r.name] = error

        threads = [threading.Thread(target=one, args=(r,), name=r.name, daemon=True) for r in self.resolution.pipelines]
        if once and any(r.stage_for for r in self.resolution.pipelines):  # a stage is filled before it is applied
            for group in ([t for t, r in zip(threads, self.resolution.pipelines) if r.stage_for or not r.name.endswith("__apply")], [t for t, r in zip(threads, self.resolution.pipelines) if not r.stage_for and r.name.endswith("__apply")]):
                for t in group:
                    t.start()
                for t in group:
                    t.join()
            return failed
        for t in threads:
            t.start()
        for t in threads:
            while t.is_alive():
                t.join(0.5)
        return failed

    def stop(self) -> None:
        self.stopping.set()


def status(resolution: Resolution) -> list[dict]:
    """How far each pipeline is, from the logs alone."""
    from ..sources.log import Table

    out = []
    for r in resolution.pipelines:
        try:
            head, done = Table(r.source_uri).head(), Table(r.target_uri).last_txn(r.app_id)
            out.append({"name": r.name, "source_head": head, "committed": done, "lag": head - (done if done is not None else r.starting_version - 1)})
        except MillraceError as e:
            out.append({"name": r.name, "error": str(e)})
    return out


def wait_until(condition: Callable[[], bool], seconds: float, pause: float = 0.05) -> bool:
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        if condition():
            return True
        time.sleep(pause)
    return condition()
