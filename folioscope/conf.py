"""Settings that belong to the meaning of the queries."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


class EngineError(Exception):
    """An expected failure, with the code and the status that a service shows for it."""

    code, status = "error", 400


class InvalidInput(EngineError, ValueError):
    """An argument outside its bounds."""

    code, status = "invalid_input", 422


class UnknownColumn(InvalidInput):
    """A filter, order or patch names a column that the frame lacks."""


# The other failures' codes and statuses.
class NotFound(EngineError):
    code, status = "not_found", 404


class Unauthorized(EngineError):
    code, status = "unauthorized", 401


class Forbidden(EngineError):
    code, status = "forbidden", 403


class Conflict(EngineError):
    code, status = "conflict", 409


class QuotaExceeded(EngineError):
    code, status = "quota_exceeded", 402


class AddressBlocked(EngineError):
    code, status = "ssrf_blocked", 422


class CrawlFailed(EngineError):
    code, status = "crawl_failed", 502


class RateLimited(EngineError):
    code, status = "rate_limited", 429


class ExternalService(EngineError):
    code, status = "external_service_error", 502


class ServiceUnavailable(EngineError):
    code, status = "service_unavailable", 503


class Configuration(EngineError):
    code, status = "configuration_error", 500


FAILURES = {k.__name__: (k.code, k.status) for k in (NotFound, Unauthorized, Forbidden, Conflict, QuotaExceeded, AddressBlocked, CrawlFailed, RateLimited, ExternalService, ServiceUnavailable, Configuration)}

# Fixed values.
PLAN_LIMITS = {"free": 10, "pro": 200, "agency": 1000, "enterprise": 100_000}
PROGRESS = {"queued": 0.05, "crawling": 0.35, "analyzing": 0.75, "completed": 1.0, "failed": 1.0}
TERMINAL = ("completed", "failed", "cancelled")
RRF_K = 60


def _weights() -> dict[str, float]:
    return {"technical": 0.35, "semantic": 0.30, "evidentiary": 0.20, "machine": 0.15}


@dataclass(frozen=True)
class EngineConf:
    """Budgets and weights; built wrong, it refuses at once."""

    chunk_size: int = 256
    overlap: int = 32
    min_tokens: int = 16
    max_chunks: int = 2000
    dimensions: int = 1536
    weights: dict[str, float] = field(default_factory=_weights)
    page_size: int = 20
    page_max: int = 100
    max_page_bytes: int = 5_000_000
    retries: int = 3

    def __post_init__(self) -> None:
        if self.chunk_size <= 0 or self.max_chunks <= 0:
            raise InvalidInput("chunk_size and max_chunks must be positive")
        if self.overlap < 0 or self.min_tokens < 0:
            raise InvalidInput("overlap and min_tokens must not be negative")
        if self.overlap >= self.chunk_size:
            raise InvalidInput("overlap must be smaller than chunk_size")
        if abs(sum(self.weights.values()) - 1) > 1e-6:
            raise InvalidInput("weights must sum to 1")

    @classmethod
    def from_env(cls, env: dict[str, str]) -> EngineConf:
        """Settings by upper-case name from an environment: numbers, and weights as JSON or as name=number with commas."""
        values: dict = {}
        for name, old in cls().__dict__.items():
            if (text := env.get(name.upper())) is not None:
                values[name] = _mapping(text) if isinstance(old, dict) else int(text)
        return cls(**values)


def _mapping(text: str) -> dict[str, float]:
    pairs = json.loads(text).items() if text.lstrip().startswith("{") else (p.split("=", 1) for p in listed(text))
    return {k.strip(): float(v) for k, v in pairs}


def listed(text: str) -> list[str]:
    """A list from a setting: JSON, or parts between commas; blank ones go."""
    parts = json.loads(text) if text.lstrip().startswith("[") else text.split(",")
    return [p for x in parts if (p := str(x).strip())]


def dotenv(text: str) -> dict[str, str]:
    """Names and values of a file of settings: comments and blank lines go, quotes around a value too, and export before a name."""
    out = {}
    for line in text.splitlines():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and not name.startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value.split(" #", 1)[0].strip()
    return out


def check_trigger(audit_id: object, project_id: object, url: str | None) -> None:
    """What starts a crawl: an audit, or a project with an address, not both."""
    if audit_id is None and not (project_id and url):
        raise InvalidInput("either audit_id, or project_id and url")
    if audit_id is not None and project_id and url:
        raise InvalidInput("either audit_id, or project_id and url, not both")


def plan_limit(tier: str | None) -> int:
    """Monthly credits of a tier; an unknown one counts as free."""
    return PLAN_LIMITS.get(tier or "", PLAN_LIMITS["free"])
