"""Text, hash and path functions."""

from __future__ import annotations

import base64
import datetime
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(text: Column) -> Column:
    """Trimmed, with every run of white space made one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def path_label(text: Column) -> Column:
    """A path label: lower case, anything but ASCII letters, digits and underscores made one underscore, never empty."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^A-Za-z0-9_]+", "_"), r"_+", "_")
    trimmed = F.trim(bare, F.lit("_"))
    return F.when(trimmed == "", "x").otherwise(trimmed)


def path_depth(path: Column) -> Column:
    """The number of non-empty labels."""
    return F.size(F.filter(F.split(path, r"\."), lambda x: x != ""))


def under(path: Column, prefix: str) -> Column:
    """The path is the prefix or below it, by whole labels."""
    return (path == prefix) | F.startswith(path, F.lit(prefix + "."))


def base_path(client: Column, doc_type: Column, version: Column) -> Column:
    return F.concat_ws(".", F.concat(F.lit("client_"), path_label(client)), F.concat(F.lit("doctype_"), path_label(doc_type)), F.concat(F.lit("v"), version.cast("string")))


def token_estimate(text: Column) -> Column:
    """A quarter of the trimmed length in characters, rounded down."""
    return F.floor(F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) / 4).cast("long")


def comparable(text: Column) -> Column:
    """White space squeezed and lower case; empty becomes null."""
    return F.nullif(F.lower(squeeze(text)), F.lit(""))


_MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
_PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    """NFKD without combining marks, case folded; rows that need none of it come as nulls."""

    def fold(value: str) -> str:
        bare = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
        return " ".join(bare.casefold().split())

    return text.map(fold, na_action="ignore")


def identity_form(text: Column) -> Column:
    """NFKD without combining marks, case folded, white space squeezed; for telling people and companies apart.

    Texts of ASCII and marked Latin letters are folded by columns; only others travel to Python.
    """
    latin = F.translate(F.lower(text), _MARKED, _PLAIN)
    other = F.rlike(latin, F.lit(r"[^\x00-\x1b\x20-\x7f]"))
    return F.nullif(F.coalesce(_folded(F.when(other, text)), squeeze(latin)), F.lit(""))


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def keyed_fingerprint(text: Column, key: bytes) -> Column:
    """The first 16 hex digits of HMAC-SHA256, composed from two digests over padded keys."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), text.cast("binary")), 256))
    return F.substring(F.sha2(F.concat(F.lit(bytearray(outer)), first), 256), 1, 16)


def redact(text: Column) -> Column:
    """Null and empty stay; up to four characters vanish; longer ones keep the last four."""
    n = F.length(text)
    return F.when(text.isNull() | (text == ""), text).when(n <= 4, "[REDACTED]").otherwise(F.concat(F.repeat(F.lit("•"), n - 4), F.right(text, F.lit(4))))


def blob_key(sha: Column, name: Column) -> Column:
    """``{digest}/{safe file name}`` of at most 80 characters, with fallbacks for empty parts."""
    last = F.element_at(F.split(F.regexp_replace(name, r"\\", "/"), "/"), -1)
    safe = F.trim(F.regexp_replace(last, r"[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.concat_ws("/", F.coalesce(F.nullif(F.lower(F.trim(sha)), F.lit("")), F.lit("_nodigest")), F.coalesce(F.nullif(F.substring(safe, 1, 80), F.lit("")), F.lit("blob")))


def cursor(at: Column, key: Column) -> Column:
    """Url-safe base 64, unpadded, of ``timestamp|id``."""
    raw = F.base64(F.encode(F.concat_ws("|", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), key.cast("string")), "utf-8"))
    return F.rtrim(F.translate(raw, "+/", "-_"), F.lit("="))


def read_cursor(value: str) -> tuple[datetime.datetime, str]:
    """Timestamp and id of a cursor; anything else than what ``cursor`` makes is a ValueError."""
    try:
        raw = base64.b64decode(value + "=" * (-len(value) % 4), altchars=b"-_", validate=True).decode()
        at, bar, key = raw.partition("|")
        if not bar or not key:
            raise ValueError("no id")
        return datetime.datetime.fromisoformat(at), key
    except Exception as problem:
        raise ValueError(f"malformed cursor: {value!r}") from problem
