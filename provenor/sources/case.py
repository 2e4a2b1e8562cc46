"""Case files: what may be collected, how far, and under which limits."""

from __future__ import annotations

import datetime as dt
import hashlib
from dataclasses import dataclass, fields

from provenor.functions import constants as K

# Source classes.
PERMITTED = ("public_registry", "public_protocol", "self_published", "platform_public_api", "open_dataset", "own_telemetry")
DENIED = ("data_broker", "breach_corpus", "authenticated_scrape", "biometric", "location_broker")


class PolicyError(ValueError):
    """A case that must not run."""


@dataclass(frozen=True)
class Case:
    case_ref: str
    authorization: str
    contact_email: str = ""
    seeds: tuple[str, ...] = ()
    pivot_radius: int = 3
    entity_types_allowed: tuple[str, ...] = ("Company", "Persona")
    robots_policy: str = "record"
    minimize: bool = True
    retention_days: int = 180
    max_requests: int = 5000
    max_nodes: int = 20_000
    max_runtime_s: int = 1800
    concurrency: int = 6
    audit_path: str = ""
    persona_collectors: tuple[str, ...] = ()
    allow_username_enumeration: bool = False
    egress: str = ""
    salt: str = ""
    jurisdictions: tuple[str, ...] = ()

    def allows_type(self, name: str) -> bool:
        return name in self.entity_types_allowed or name == "Unknown"

    def expiry(self, now: dt.datetime) -> dt.datetime:
        return now + dt.timedelta(days=self.retention_days)

    def persona_gate(self, collector: str) -> tuple[bool, str]:
        """Two keys: personas are in scope, and this collector is named."""
        if "Persona" not in self.entity_types_allowed:
            return False, "personas are not in scope"
        return (True, "") if collector in self.persona_collectors else (False, f"collector {collector} is not named")

    def store_salt(self) -> bytes | None:
        return self.salt.encode() if self.minimize else None

    def audit_code(self, value: str) -> str:
        return "min:" + hashlib.sha256((self.store_salt() or b"") + value.encode()).hexdigest()[:24]


_NUMBERS = ("pivot_radius", "max_requests", "max_nodes", "max_runtime_s", "retention_days", "concurrency")
_BUDGET = ("max_requests", "max_nodes", "max_runtime_s", "concurrency")
#: Accepted in a file and not used: the deny list is not the file's to change.
_UNUSED = ("blacklist", "denied_source_classes")


def source_class(name: str) -> str:
    if name in DENIED:
        raise PolicyError(f"source class {name} is denied")
    return name


def parse(raw) -> Case:
    """A mapping as read from YAML or JSON; unknown keys, loose booleans and budgets below 1 are refused."""
    if not isinstance(raw, dict):
        raise PolicyError("a case file is a mapping")
    raw = dict(raw)
    budget = raw.pop("budget", {}) or {}
    for k, v in budget.items():
        if k not in _BUDGET:
            raise PolicyError(f"unknown budget: {k}")
        if k in raw and raw[k] != v:
            raise PolicyError(f"{k} is given twice")
        raw[k] = v
    for k in _UNUSED:
        raw.pop(k, None)
    known = {f.name for f in fields(Case)}
    if unknown := sorted(set(raw) - known):
        raise PolicyError(f"unknown keys: {', '.join(unknown)}")
    for k in ("case_ref", "authorization"):
        if not raw.get(k):
            raise PolicyError(f"{k} is required")
    for k in _NUMBERS:
        if k in raw and (isinstance(raw[k], bool) or not isinstance(raw[k], int) or raw[k] < 1):
            raise PolicyError(f"{k} must be a positive whole number")
    for k in ("minimize", "allow_username_enumeration"):
        if k in raw and not isinstance(raw[k], bool):
            raise PolicyError(f"{k} must be true or false")
    for k in ("seeds", "persona_collectors", "entity_types_allowed", "jurisdictions"):
        if k in raw:
            raw[k] = tuple(raw[k])
    if raw.get("robots_policy", "record") not in ("respect", "record", "ignore"):
        raise PolicyError("robots_policy is respect, record or ignore")
    if bad := [t for t in raw.get("entity_types_allowed", ()) if t not in K.TYPE_RANK]:
        raise PolicyError(f"unknown entity types: {bad}")
    return Case(**raw)


def load(path: str) -> Case:
    """YAML where a YAML reader is installed, else JSON."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        raw = yaml.safe_load(text)
    except ImportError:
        import json

        raw = json.loads(text)
    return parse(raw)
