"""Replacing identifiers by salted digests in what leaves a case. One digest for all outputs."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, quote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(value: str, salt: bytes) -> str:
    return "min:" + hashlib.blake2b(salt + value.encode(), digest_size=12).hexdigest()


def spellings(value: str) -> set[str]:
    """The forms that URL builders and file names give a value."""
    cases = {value, value.lower(), value.upper()} - {""}
    changed = [f for c in cases for f in (quote(c), quote(c, safe=""), quote_plus(c), *(c.replace(" ", x) for x in ("_", "-", "")))]
    return cases.union(changed) - {""}


def scrubber(values: list[str], salt: bytes):
    """A function over texts. All forms are one alternation, longest first, so one pass replaces all."""
    forms = {f: digest(v, salt) for v in sorted(values) for f in spellings(v)}
    if not forms:
        return lambda text: text
    pattern = re.compile("(?<![0-9A-Za-z])(?:" + "|".join(map(re.escape, sorted(forms, key=lambda f: (-len(f), f)))) + ")(?![0-9A-Za-z])")
    return lambda text: pattern.sub(lambda m: forms[m[0]], text)


def scrub(texts: DataFrame, column: str, values: list[str], salt: bytes) -> DataFrame:
    """Scrub a text column of a case's values."""
    run = scrubber(values, salt)

    @F.pandas_udf("string")
    def clean(s: pd.Series) -> pd.Series:
        return s.map(run, na_action="ignore")

    return texts.withColumn(column, clean(F.col(column)))


# Words in the names of fields whose values are personal; plurals hold them too.
SENSITIVE_WORDS = (
    "email", "person", "person_name", "handle", "phone", "address", "postal_address", "registrant", "subject", "claim", "identifier", "target",
    "query", "name",
)
#: A word without its last s, so that any number of them is found.
_STEMS = tuple(w.rstrip("s") for w in SENSITIVE_WORDS)


def sensitive(field: Column) -> Column:
    return F.lower(field).rlike("|".join(_STEMS))


def minimise_audit(record, values: set[str], salt: bytes, depth: int = 6):
    """A record with sensitive fields and known values replaced, to a bounded depth."""
    code = lambda v: "min:" + hashlib.sha256(salt + str(v).encode()).hexdigest()[:24]
    if depth < 0:
        return code(record)
    if isinstance(record, dict):
        return {k: code(v) if isinstance(v, str) and any(w in k.lower() for w in _STEMS) else minimise_audit(v, values, salt, depth - 1) for k, v in record.items()}
    if isinstance(record, (list, tuple)):
        return [minimise_audit(v, values, salt, depth - 1) for v in record]
    if isinstance(record, str):
        for v in sorted(values, key=len, reverse=True):
            record = record.replace(v, code(v)) if v else record
    return record
