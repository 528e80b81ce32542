"""Scalar functions as column expressions (all JVM-side) with Python twins for use inside parsers."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_text(value) -> str:
    """A string as it is; anything else as JSON with its non-ASCII letters kept."""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def token_estimate(value) -> int:
    """A quarter of the characters of the text form, rounded up; nothing for empty values."""
    return math.ceil(len(as_text(value)) / 4) if value else 0


def short_hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()[:24]


def estimate_tokens(text: Column) -> Column:
    return F.coalesce(F.ceil(F.length(text) / 4), F.lit(0)).cast("long")


def hash_text(text: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, length)


def candidate_id(family: Column) -> Column:
    return hash_text(F.concat(F.lit("v2:"), family), 12)


#: Fixed values: (pattern, replacement) in the order in which they apply. Java syntax; (?U) makes \w and \b know all letters.
REDACTIONS = (
    (r"(?s)-----BEGIN [^-]*PRIVATE KEY-----.*?-----END [^-]*PRIVATE KEY-----", "<redacted-private-key>"),
    (r"(?U)\b(?:sk-[A-Za-z0-9_-]{12,}|gh[pousr]_[A-Za-z0-9_]{12,}|github_pat_[A-Za-z0-9_]+|AKIA[A-Z0-9]{16})\b", "<redacted-secret>"),
    (r"(?iU)(bearer\s+)\S+", "$1<redacted-secret>"),
    (r"""(?iU)((?:[\w-]*(?:password|passwd|secret|token|api[_-]?key)[\w-]*)["']?\s*[:=]\s*)(?:"[^"]*"|'[^']*'|[^\s,;}]+)""", "$1<redacted-secret>"),
    (r"""(?iU)(--(?:password|token|secret|api-key)\s+)(?:"[^"]*"|'[^']*'|\S+)""", "$1<redacted-secret>"),
    (r"(?U)(\w+://)[^\s/@:]+:[^\s/@]+@", "$1<redacted-credentials>@"),
    (r"""(?U)(?<!\w)(?:/(?:Users|home)/[^\s/'"]+|[A-Za-z]:\\Users\\[^\\\s]+)""", "<home>"),
)


#: What a text must have for the redaction of the same place to find anything; cheaper to look for.
HINTS = ("PRIVATE KEY", "sk-|gh[pousr]_|github_pat_|AKIA", "(?i)bearer", "(?i)passw|secret|token|api", "--", "://", r"/|\\Users")


def redact(text: Column) -> Column:
    """Best-effort removal of keys, tokens, credentials and home folders."""
    for (pattern, replacement), hint in zip(REDACTIONS, HINTS, strict=True):
        text = F.when(text.rlike(hint), F.regexp_replace(text, pattern, replacement)).otherwise(text)
    return text


def budgeted(compact: Column, budget: int) -> Column:
    """A compact size is never taken below the result budget."""
    return F.greatest(F.lit(budget).cast("long"), compact)


def saved(before: Column, after: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), before - after)
