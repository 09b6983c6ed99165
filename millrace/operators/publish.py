"""Messages about committed batches, sent after the commit and never able to fail it.

The rows are a SELECT over the batch (at most a sum, count, min or max of it), rendered before the commit.
Every batch has its place in the chain of versions, whether its message arrived or
not, so that a reader can tell that it missed one.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import hmac
import json
import logging
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, MillraceError
from ..plans.gate import Grain
from ..plans.transform import SqlTransform

log = logging.getLogger(__name__)

ENVELOPE_VERSION = 1
MAX_PAYLOAD = 1_000_000
FAILURES, COOLDOWN = 5, 60.0
API_VERSION = "2024-12-01"
TOKEN_SECONDS = 60
_GROUP = re.compile(r"[A-Za-z0-9][A-Za-z0-9._:-]{0,127}")


class PublishError(MillraceError):
    """A message couldn't be sent."""


class Sender(Protocol):
    def publish(self, group: str, body: bytes) -> None: ...

    def describe(self) -> str: ...


def valid_group(name: str) -> bool:
    return bool(_GROUP.fullmatch(name))


def bearer(key: str, audience: str, now: int, seconds: int = TOKEN_SECONDS) -> str:
    """A signed token (HS256) for one URL."""
    part = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
    said = part(json.dumps(dict(alg="HS256", typ="JWT"), separators=(",", ":")).encode()) + "." + part(json.dumps({"aud": audience, "iat": now, "exp": now + seconds}, separators=(",", ":")).encode())
    return said + "." + part(hmac.digest(key.encode(), said.encode(), hashlib.sha256))


@dataclass(frozen=True)
class WebPubSub:
    """Sends to a group of a hub over HTTP."""

    endpoint: str
    key: str = field(repr=False)
    hub: str = "hub"
    ttl_seconds: int = 0
    timeout: float = 10.0

    @classmethod
    def from_connection_string(cls, text: str, hub: str, ttl_seconds: int = 0, timeout: float = 10.0) -> WebPubSub:
        parts = {k.strip().lower(): v.strip() for k, _, v in (p.partition("=") for p in text.split(";")) if v}
        if not parts.get("endpoint"):
            raise ConfigError("the connection string has no Endpoint=")
        if not parts.get("accesskey"):
            raise ConfigError("the connection string has no AccessKey=, or an empty one")
        endpoint = parts["endpoint"]
        if not endpoint.startswith(("http://", "https://")):
            endpoint = f"https://{endpoint}"
        return cls(endpoint.rstrip("/"), parts["accesskey"], hub, ttl_seconds, timeout)

    def url(self, group: str) -> str:
        for what, name in (("hub", self.hub), ("group", group)):
            if not valid_group(name):
                raise ConfigError(f"the {what} {name!r} has characters that a path can't hold; use letters, digits and . _ - :")
        asked = {"api-version": API_VERSION} | ({"messageTtlSeconds": self.ttl_seconds} if self.ttl_seconds > 0 else {})
        return "/".join([self.endpoint, "api", "hubs", self.hub, "groups", group, ":send"]) + "?" + urllib.parse.urlencode(asked)

    def publish(self, group: str, body: bytes) -> None:
        url = self.url(group)
        request = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {bearer(self.key, url, int(time.time()))}"}, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout):
                return
        except urllib.error.HTTPError as e:
            code = e.headers.get("x-ms-error-code") or ""
            raise PublishError(f"{self.describe()} answered {e.code} {code} {e.read(300).decode('utf-8', 'replace')}".rstrip()) from None
        except OSError as e:
            raise PublishError(f"{self.describe()}: {e}") from None

    def describe(self) -> str:
        return f"{self.endpoint}, hub {self.hub}"


class Breaker:
    """After so many failures in a row nothing is tried for a while."""

    def __init__(self, failures: int = FAILURES, cooldown: float = COOLDOWN, clock: Callable[[], float] = time.monotonic):
        self.most, self.cooldown, self.clock = failures, cooldown, clock
        self.failures, self.until = 0, 0.0

    def open(self) -> bool:
        return self.failures >= self.most and self.clock() < self.until

    def succeeded(self) -> None:
        self.failures = 0

    def failed(self) -> None:
        self.failures += 1
        if self.failures >= self.most:
            self.until = self.clock() + self.cooldown


@dataclass
class Rendered:
    rows: list[dict]
    count: int
    complete: bool


@dataclass
class Stats:
    sent: bool = False
    failed: bool = False
    skipped: bool = False
    truncated: bool = False
    rows: int = 0
    bytes: int = 0


def render(df: DataFrame, most_bytes: int = MAX_PAYLOAD) -> Rendered:
    """The rows as JSON values. Beyond the size no rows, but still their number: rows are fetched only when they are known to fit."""
    made = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("row"))
    count, size = made.agg(F.count("row"), F.coalesce(F.sum(F.octet_length("row") + 1), F.lit(0))).first()
    if size > most_bytes:
        return Rendered([], count, False)
    return Rendered([json.loads(text) for (text,) in made.collect()], count, True)  # at most so many bytes


class Publisher:
    """One publication of a pipeline."""

    def __init__(self, sender: Sender, pipeline: str, app_id: str, model: str, group: str, sql: str | None = None, most_bytes: int = MAX_PAYLOAD, breaker: Breaker | None = None):
        if not valid_group(group):
            raise ConfigError(f"{group!r} is no name for a group: 1 to 128 letters, digits and . _ : -, beginning with a letter or digit")
        self.sender, self.pipeline, self.app_id, self.model, self.group, self.sql = sender, pipeline, app_id, model, group, sql
        self.most_bytes, self.breaker = most_bytes, breaker or Breaker()
        self.previous: int | None = None

    def render(self, batch: DataFrame) -> Rendered | Exception | None:
        """Before the commit; a failure is kept for the statistics. None while the breaker is open."""
        if self.breaker.open():
            return None
        try:
            df = batch if self.sql is None else SqlTransform(batch.sparkSession, self.sql, grain=Grain.BATCH).apply(batch)
            return render(df, self.most_bytes)
        except Exception as e:
            log.warning("%s: the message can't be made: %s", self.pipeline, e)
            return e

    def send(self, rendered: Rendered | Exception | None, first: int, last: int, target_version: int | None) -> Stats:
        """After the commit; never raises. The chain goes on whatever happens."""
        before, self.previous = self.previous, last
        if rendered is None:
            return Stats(skipped=True)
        if isinstance(rendered, Exception):
            self.breaker.failed()
            return Stats(failed=True)
        made = {
            "millrace": ENVELOPE_VERSION,
            "pipeline": self.pipeline,
            "app_id": self.app_id,
            "model": self.model,
            "group": self.group,
            "prev_source_version": before,
            "from_source_version": first,
            "source_version": last,
            "target_version": target_version,
            "committed_at": dt.datetime.now(dt.timezone.utc).isoformat(timespec="milliseconds"),
            "complete": rendered.complete,
            "row_count": rendered.count,
            "rows": rendered.rows,
        }
        try:
            body = json.dumps(made, separators=(",", ":")).encode()
            self.sender.publish(self.group, body)
        except Exception as e:
            self.breaker.failed()
            log.warning("%s: %s", self.pipeline, e)
            return Stats(failed=True)
        self.breaker.succeeded()
        return Stats(sent=True, truncated=not rendered.complete, rows=len(rendered.rows), bytes=len(body))
