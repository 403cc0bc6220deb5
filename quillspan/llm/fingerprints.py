"""Document fingerprints: context-triggered piecewise hashing, compared by edit distance."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import mix
from quillspan.llm.ordered import with_next

#: Bytes that the rolling hash sees, the least block size, and the pieces that a signature aims at.
WINDOW, LEAST_BLOCK, PIECES = 7, 3, 64
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _rolling(data: np.ndarray) -> np.ndarray:
    """At each byte a 32-bit hash of the last WINDOW bytes (of fewer at the start)."""
    x = data.astype(np.uint64)
    out = x.copy()
    for back in range(1, WINDOW):
        out[back:] += x[:-back] << np.uint64(7 * back)
    return (mix(out) >> np.uint64(32)).astype(np.uint32)


def _signature(data: bytes, ends: np.ndarray) -> str:
    """One base-64 digit for each piece: six bits of its checksum."""
    out, start = [], 0
    for end in ends.tolist():
        out.append(_DIGITS[zlib.crc32(data[start:end]) >> 26])
        start = end
    if start < len(data):
        out.append(_DIGITS[zlib.crc32(data[start:]) >> 26])
    return "".join(out)


def fingerprint(data: bytes) -> str:
    """``block:signature:signature at twice the block``; equal texts have equal fingerprints.

    A piece ends where the rolling hash modulo the block size is the block size less 1. The
    block size is LEAST_BLOCK doubled until about PIECES pieces remain, then halved while the
    signature has fewer than half as many digits. The empty text gives ``3::``.
    """
    block = LEAST_BLOCK
    while block * PIECES < len(data):
        block *= 2
    if not data:
        return f"{block}::"
    rolled = _rolling(np.frombuffer(data, dtype=np.uint8))

    def ends(size: int) -> np.ndarray:
        return np.flatnonzero(rolled % np.uint32(size) == size - 1) + 1

    at = ends(block)
    while block > LEAST_BLOCK and len(at) < PIECES // 2:
        block //= 2
        at = ends(block)
    return f"{block}:{_signature(data, at)}:{_signature(data, ends(2 * block))}"


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and substitutions between two signatures (bit-parallel, Myers 1999)."""
    if not a or not b:
        return max(len(a), len(b))
    n, peq = len(a), {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << n - 1
    pv, mv, score = full, 0, n
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 | 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
    return score


def likeness(left: str, right: str) -> float:
    """0 to 1: 1 less edit distance over the longer signature, at the block sizes both have; else 0.

    Where two sizes agree the larger likeness counts. Equal fingerprints are alike to 1.
    """
    if left == right:
        return 1.0
    (a, a1, a2), (b, b1, b2) = (x.split(":") for x in (left, right))
    pairs: list[tuple[str, str]] = []
    if int(a) == 2 * int(b):
        pairs = [(a1, b2)]
    elif int(b) == 2 * int(a):
        pairs = [(a2, b1)]
    elif a == b:
        pairs = [(a1, b1), (a2, b2)]
    return max([0.0, *(1 - edit_distance(x, y) / max(len(x), len(y)) for x, y in pairs if x or y)])


def add_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with a fingerprint column; null texts count as empty. One narrow pass, no shuffle."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint((t or "").encode()))

    return docs.withColumn(name, of(F.col(text)))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to that and to the next document.

    The edited text has its last floor(n/4) code points replaced by the first as many (or all)
    of the next document in ascending doc_id; after the last comes the first. One document
    alone is its own next. Null texts are empty; rows of one doc_id are ordered by a digest of
    the text, a null doc_id comes first. The texts are shuffled once, compressed.
    """

    def one(k, t, u):
        quarter = len(t) // 4
        edited = t[: len(t) - quarter] + u[:quarter]
        own, new, following = fingerprint(t.encode()), fingerprint(edited.encode()), fingerprint(u.encode())
        return k, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, new, likeness(own, new), likeness(own, following)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs.select("doc_id", "text"), one, schema)
