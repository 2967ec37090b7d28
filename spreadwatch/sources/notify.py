"""Alert texts and where they go. Sending never raises: a dead channel must not stop the scan."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest message each channel takes, and its time limit in seconds.
MAX_TEXT, MAX_DISCORD, TIMEOUT = 4000, 1900, 10.0
NOTES = {
    "validation": "validation lane: an identity that should hold; a gap points at the data",
    "observational": "observational: watch it, it cannot be traded both ways",
    "tradeable": "tradeable: both legs are reachable",
}


def shortened(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most - 3] + "..."


def message(most: int = MAX_TEXT) -> Column:
    """The alert text of rows with linkage_id, category, spread_bps, kz, beta, percentile, half_life, t, expected_bps, net_bps, friction."""
    line = lambda fmt, *cols: F.when(F.array_contains(F.array(*[F.col(c).isNull() for c in cols]), True), F.lit(None)).otherwise(F.format_string(fmt, *cols))
    drift = F.when(F.abs(F.col("beta") - 1) > 0.01, F.format_string("beta is %.1f%% away from 1: the conversion constant may be out of date", F.abs(F.col("beta") - 1) * 100))
    note = F.create_map(*[F.lit(x) for kv in NOTES.items() for x in kv])[F.col("category")]
    text = F.concat_ws(
        "\n", F.concat(F.lit("ALERT "), F.col("linkage_id")), line("spread     %+.1f bps", "spread_bps"), line("filter z   %+.2f (beta %.4f)", "kz", "beta"),
        line("percentile %.2f", "percentile"), line("half-life  %.2f (t %+.1f)", "half_life", "t"), line("reverts    %+.1f bps", "expected_bps"),
        line("friction   %.1f bps", "friction"), line("NET        %+.1f bps", "net_bps"), drift, note,
    )
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


class Notifier(Protocol):
    def send(self, text: str) -> bool: ...


@dataclass
class MemoryNotifier:
    """Keeps what it is sent."""

    texts: list[str] = field(default_factory=list)

    def send(self, text: str) -> bool:
        self.texts.append(text)
        return True


class ConsoleNotifier:
    def send(self, text: str) -> bool:
        print(text, flush=True)
        return True


def _post(url: str, body: bytes, headers: dict[str, str]) -> None:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=TIMEOUT) as reply:
        reply.read()


@dataclass
class HttpNotifier:
    """Posts texts to one channel and counts what became of them."""

    name: str
    url: str
    body: Callable[[str], tuple[bytes, dict[str, str]]]
    most: int = MAX_TEXT
    post: Callable[[str, bytes, dict[str, str]], None] = _post
    sent: int = 0
    failed: int = 0
    last_error: str | None = None

    def send(self, text: str) -> bool:
        try:
            self.post(self.url, *self.body(shortened(text, self.most)))
        except (urllib.error.URLError, OSError, ValueError) as exc:
            self.failed, self.last_error = self.failed + 1, f"{self.name}: {type(exc).__name__}"  # no address: it holds the token
            return False
        self.sent += 1
        return True

    def verify(self) -> bool:
        return self.send(f"{self.name}: test message")


def _json(**fields: str) -> tuple[bytes, dict[str, str]]:
    return json.dumps(fields).encode(), {"Content-Type": "application/json"}


def telegram(token: str, chat: str) -> HttpNotifier:
    return HttpNotifier("telegram", f"https://api.telegram.org/bot{token}/sendMessage", lambda t: _json(chat_id=chat, text=t))


def ntfy(topic: str, server: str = "https://ntfy.sh") -> HttpNotifier:
    return HttpNotifier("ntfy", f"{server.rstrip('/')}/{topic}", lambda t: (t.encode(), {"Title": "alert"}))


def discord(webhook: str) -> HttpNotifier:
    return HttpNotifier("discord", webhook, lambda t: _json(content=t), MAX_DISCORD)


@dataclass
class FanOut:
    """Sends to every target, whatever the others do; true if any took it."""

    targets: list[Notifier]

    def send(self, text: str) -> bool:
        return any([t.send(text) for t in self.targets])


def from_env(console: bool = True) -> FanOut:
    """Targets for which the environment has settings."""
    get, targets = os.environ.get, [ConsoleNotifier()] if console else []
    if get("TELEGRAM_TOKEN") and get("TELEGRAM_CHAT"):
        targets.append(telegram(get("TELEGRAM_TOKEN"), get("TELEGRAM_CHAT")))
    if get("NTFY_TOPIC"):
        targets.append(ntfy(get("NTFY_TOPIC"), get("NTFY_SERVER", "https://ntfy.sh")))
    if get("DISCORD_WEBHOOK"):
        targets.append(discord(get("DISCORD_WEBHOOK")))
    return FanOut(targets)
