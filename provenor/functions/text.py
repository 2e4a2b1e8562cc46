"""Normalisation of identifier values and detection of disguised text, as Column expressions."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from provenor.functions import constants as K


def _class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def is_in(value: Column, items) -> Column:
    return value.isin(*items) if items else F.lit(False)


def lookup(table: dict, key: Column, default=None) -> Column:
    """A dimension value by key, as a literal map."""
    pairs = [F.lit(x) for k, v in table.items() if v is not None for x in (k, v)]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def compatible(value: Column) -> Column:
    """NFKC. Plain ASCII is its own normal form and never reaches Python's result."""
    odd = value.rlike(r"[^\x00-\x7F]")
    # functions for Python workers are made where they are used: workers import this module too
    return F.when(odd, F.pandas_udf(_nfkc, "string")(F.when(odd, value))).otherwise(value)


def _steps(value: Column, case_fold: Column | bool, collapse: bool, ascii_only: bool) -> list[tuple[str, Column]]:
    """(finding, value after the step) in order."""
    out, s = [], value
    for name, chars in (("control_char", K.CONTROLS), ("zero_width", _class(K.ZERO_WIDTH)), ("bidi_control", _class(K.BIDI))):
        s = F.regexp_replace(s, chars, "")
        out.append((name, s))
    s = F.translate(s, K.HOMOGLYPHS_FROM, K.HOMOGLYPHS_TO)
    out.append(("homoglyph", s))
    s = F.translate(s, K.PUNCTUATION_FROM, K.PUNCTUATION_TO)
    out.append(("confusable_punct", s))
    if not ascii_only:
        s = compatible(s)
        out.append(("compatibility", s))
    white = r"[\s\x1c-\x1f\x85\p{Z}]+"
    s = F.regexp_replace(s, f"^{white}|{white}$", "")
    if collapse:
        s = F.regexp_replace(s, white, " ")
    out.append(("whitespace", s))
    fold = F.lit(case_fold) if isinstance(case_fold, bool) else case_fold
    s = F.when(fold, F.lower(s)).otherwise(s)
    out.append(("case_variant", s))
    return out


def normalise(value: Column, case_fold: Column | bool = False, collapse: bool = True, ascii_only: bool = False) -> Column:
    """The canonical form. ``ascii_only`` leaves out NFKC, for values known to need none."""
    return _steps(value, case_fold, collapse, ascii_only)[-1][1]


def findings(value: Column, case_fold: Column | bool = False, collapse: bool = True, ascii_only: bool = False) -> Column:
    """The sorted names of the steps that changed the value."""
    found, before = [], value
    for name, after in _steps(value, case_fold, collapse, ascii_only):
        found.append(F.when(after != before, F.lit(name)))
        before = after
    return F.array_sort(F.array_compact(F.array(*found)))


def deliberate(found: Column) -> Column:
    return F.arrays_overlap(found, F.array(*[F.lit(x) for x in K.DELIBERATE]))


def canonical(value: Column, kind: Column) -> Column:
    return normalise(value, kind.isin(*K.CASE_INSENSITIVE, "lei"))


def scan(text: Column) -> Column:
    """Which kinds of disguise a text holds; the text stays as it is."""
    tests = (("bidi_control", _class(K.BIDI)), ("control_char", K.CONTROLS), ("homoglyph", _class(K.HOMOGLYPHS_FROM)), ("zero_width", _class(K.ZERO_WIDTH)))
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in tests]))


def identifier_value(kind: Column, value: Column, ascii_only: bool = False) -> Column:
    """An identifier's value in its kind's normal form."""
    s = normalise(value, kind.isin(*K.CASE_INSENSITIVE), ascii_only=ascii_only)
    s = F.when(kind.isin(*K.DOT_STRIPPED), F.regexp_replace(s, r"\.+$", "")).otherwise(s)
    bare = F.regexp_replace(s, "^0+", "")
    # lpad would cut what is longer
    cik = F.when(F.length(bare) < 10, F.lpad(bare, 10, "0")).otherwise(bare)
    return F.when(kind == "lei", F.upper(s)).when(kind == "cik", cik).otherwise(s)


def observed(kind: Column, raw: Column, ascii_only: bool = False) -> Column:
    """value, key, observed_as (null where it is the value) and was_obfuscated of an identifier as it was met."""
    value = identifier_value(kind, raw, ascii_only)
    found = findings(raw, kind.isin(*K.CASE_INSENSITIVE), ascii_only=ascii_only)
    return F.struct(value.alias("value"), key(kind, value).alias("key"), F.when(raw != value, raw).alias("observed_as"), F.coalesce(deliberate(found), F.lit(False)).alias("was_obfuscated"), found.alias("findings"))


def key(kind: Column, value: Column) -> Column:
    return F.concat_ws(":", kind, value)


def kind_of(identifier: Column) -> Column:
    kind = F.split_part(identifier, F.lit(":"), F.lit(1))
    return F.when(kind.isin(*K.KINDS), kind).otherwise(F.lit("url"))


def entity_type(kind: Column) -> Column:
    return lookup(K.ENTITY_TYPES, kind, "Unknown")


def blake2b(value: Column, salt: bytes, size: int) -> Column:
    """Salted BLAKE2b in hex; Spark has no such function."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: hashlib.blake2b(salt + x.encode(), digest_size=size).hexdigest(), na_action="ignore")

    return run(value)


def masked(identifier: Column, salt: bytes) -> Column:
    return blake2b(identifier, salt, 16)


def minimised(value: Column, salt: bytes) -> Column:
    return F.concat(F.lit("min:"), blake2b(value, salt, 12))


def audit_digest(value: Column, salt: bytes) -> Column:
    return F.concat(F.lit("min:"), F.substring(F.sha2(F.concat(F.lit(salt), value.cast("binary")), 256), 1, 24))


def seed(text: Column) -> tuple[Column, Column]:
    """Kind and value of a seed: a known prefix, else an address with @, else a domain."""
    prefix, rest = F.split_part(text, F.lit(":"), F.lit(1)), F.regexp_replace(text, "^[^:]*:", "")
    known = text.contains(":") & prefix.isin(*K.KINDS)
    kind = F.when(known, prefix).when(text.contains("@"), F.lit("email")).otherwise(F.lit("domain"))
    return kind, F.when(known, rest).otherwise(text)
