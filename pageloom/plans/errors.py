"""What can go wrong, with stable codes: as exceptions, and as a column of a table of fetches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions import urls

PHASES = ("fetch", "parse", "extract", "convert")
SOURCES = ("rss", "sitemap", "html")


class ScrapeError(Exception):
    """An error with a stable code; further facts about it are attributes."""

    code = "SCRAPER_ERROR"

    def __init__(self, message: str = "", url: str | None = None, **facts: object) -> None:
        super().__init__(message or self.code)
        self.url = url
        for name, value in facts.items():
            setattr(self, name, value)


class ConfigError(ScrapeError):
    code = "INVALID_CONFIG"


class UnsupportedInput(ScrapeError):
    code = "UNSUPPORTED_INPUT"


class TimedOut(ScrapeError):
    """``timeout``: milliseconds."""

    code = "REQUEST_TIMEOUT"


class Aborted(ScrapeError):
    code = "REQUEST_ABORTED"


class RateLimited(ScrapeError):
    """``host``, and ``retry_after`` in milliseconds if it is known."""

    code = "RATE_LIMIT_EXCEEDED"


class RobotsBlocked(ScrapeError):
    """``disallowed_path``: what robots.txt names."""

    code = "ROBOTS_BLOCKED"


class ExtractionFailed(ScrapeError):
    """``phase``: one of PHASES."""

    code = "CONTENT_EXTRACTION_FAILED"


class NothingFound(ScrapeError):
    """``tried``: some of SOURCES."""

    code = "NO_CONTENT_FOUND"


class InvalidUrl(ScrapeError):
    """``status``: that of the response, if there was one."""

    code = "INVALID_URL"


class CircuitOpen(ScrapeError):
    """``reset_at``: when calls may go again, in milliseconds."""

    code = "CIRCUIT_OPEN"


BY_CODE = {c.code: c for c in (ScrapeError, ConfigError, UnsupportedInput, TimedOut, Aborted, RateLimited, RobotsBlocked, ExtractionFailed, NothingFound, InvalidUrl, CircuitOpen)}


def is_scrape_error(error: object) -> bool:
    return isinstance(error, ScrapeError)


def is_abort(error: object) -> bool:
    """Whether a call ended since somebody wanted it to: ours, or an interrupt."""
    return isinstance(error, (Aborted, KeyboardInterrupt))


def error_code(url: Column, status: Column, message: Column, found: Column, allowed: Column | None = None, state: Column | None = None) -> Column:
    """The code of a fetch, null if nothing is wrong: ``found`` is whether content came of it, ``allowed``
    what robots.txt says, ``state`` that of the circuit breaker."""
    says = lambda pattern: F.coalesce(message.rlike(f"(?i){pattern}"), F.lit(False))
    no = F.lit(False)
    return (
        F.when(~urls.is_valid(url), InvalidUrl.code)
        .when(no if state is None else F.coalesce(state == "open", no), CircuitOpen.code)
        .when(no if allowed is None else F.coalesce(~allowed, no), RobotsBlocked.code)
        .when(says("abort"), Aborted.code)
        .when(says("time-?d? ?out") | (F.coalesce(status, F.lit(0)) == 408), TimedOut.code)
        .when(F.coalesce(status, F.lit(0)) == 429, RateLimited.code)
        .when(F.coalesce(status, F.lit(0)).isin(400, 404, 410), InvalidUrl.code)
        .when(message.isNotNull() | (F.coalesce(status, F.lit(200)) >= 400), ScrapeError.code)
        .when(found.isNull(), NothingFound.code)
        .when(~found, ExtractionFailed.code)
    )
