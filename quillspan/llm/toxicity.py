"""Toxicity: noisy-channel restoration of disguised words, then a linear score of the restored text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a disguised character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
#: Symbols of the language model: a to z, then the word boundary, then any other letter.
BOUNDARY, OTHER, SYMBOLS = 26, 27, 28
#: Natural-log costs of the channel: a letter as itself, a substitution, three or more of a letter
#: kept, those dropped but for one or two, and a pair made one.
KEEP, SUBSTITUTE, REPEAT_KEPT, REPEAT_DROPPED, PAIR_DROPPED = 0.0, -1.0, -1.5, -0.7, -5.0
#: Words of spaced letters count if a path through them costs at most so much more than the best one.
MARGIN = 12.0

#: Words, and disguised tokens, that one worker remembers.
REMEMBERED = 100_000
#: Characters of a token that is remembered; longer ones are restored anew.
REMEMBERED_LENGTH = 64

_WORD = re.compile(r"[^\W\d_]+")
_LEET_CLASS = re.escape("".join(LEET))
# A whole run of letters and stand-ins that has a stand-in, of any length.
_RUN = re.compile(rf"(?<![a-z{_LEET_CLASS}])[a-z]*+[{_LEET_CLASS}][a-z{_LEET_CLASS}]*+")
# Letters one by one with the same kind of gap between them, however many.
_SPACED = re.compile(rf"(?<!\w)[a-z{_LEET_CLASS}]([ .\-_*~])[a-z{_LEET_CLASS}](?:\1[a-z{_LEET_CLASS}])*(?!\w)")
_REPEATED = re.compile(r"(?<!\w)(?=[a-z]*?([a-z])\1\1)[a-z]++(?!\w)")
_GAPS = frozenset(" .-_*~")
_LETTER = re.compile("[a-z]")
#: Stand-ins that may also be marks beside a word.
MARKS = "!|+($"
_STAND_INS = frozenset("".join(LEET))


def symbols_of(text: bytes) -> np.ndarray:
    """The language model's symbols of a lower-cased text in UTF-8: a run of anything but letters is one boundary."""
    return _SYMBOL[np.frombuffer(text, dtype=np.uint8)]


_SYMBOL = np.full(256, BOUNDARY, dtype=np.int64)
_SYMBOL[97:123] = np.arange(26)
_SYMBOL[65:91] = np.arange(26)
_SYMBOL[128:] = OTHER


def trigram_counts(texts: Iterator[str]) -> np.ndarray:
    """Counts of three symbols in a row, over whole texts."""
    counts = np.zeros(SYMBOLS**3, dtype=np.int64)
    for text in texts:
        x = symbols_of(f"  {text} ".encode())
        counts += np.bincount(x[:-2] * SYMBOLS**2 + x[1:-1] * SYMBOLS + x[2:], minlength=SYMBOLS**3)
    return counts


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log probabilities of a symbol after two others, from the counts over all documents.

    Counts are summed inside each partition before the shuffle; the driver gets SYMBOLS cubed
    numbers at most, whatever the input.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for x in batches:
            total += trigram_counts(t for t in x["t"] if t)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"g": at, "n": total[at]})

    rows = docs.select(F.col(text).alias("t")).mapInPandas(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
    counts = np.full(SYMBOLS**3, 0.5)
    for g, n in rows:
        counts[g] += n
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    return np.log(counts / counts.sum(axis=2, keepdims=True))


def lattice(observed: str) -> list[list[tuple[int, float, int]]]:
    """For each position: (symbol, cost, characters used); long repeats are shortened."""
    out: list[list[tuple[int, float, int]]] = []
    run = 0
    for i in range(len(observed) - 1, -1, -1):
        c = observed[i]
        run = run + 1 if observed[i + 1 : i + 2] == c else 1
        letters = [(ord(x) - 97, SUBSTITUTE) for x in LEET[c]] if c in LEET else [(ord(c) - 97, KEEP)]
        if run > 2:
            out.append([e for x, cost in letters for e in ((x, cost + REPEAT_KEPT, 1), (x, cost + REPEAT_DROPPED, run - 1), (x, cost + REPEAT_DROPPED, run))])
        elif run == 2 and c not in LEET:
            out.append([(letters[0][0], KEEP, 1), (letters[0][0], PAIR_DROPPED, 2)])
        else:
            out.append([(x, cost, 1) for x, cost in letters])
    return out[::-1]


def _spelled(link: tuple | None) -> str:
    """The letters of a path from its last to its first link."""
    out = []
    while link is not None:
        link, symbol = link
        out.append(chr(97 + symbol))
    return "".join(reversed(out))


def restore(observed: str, model: np.ndarray | list, ends: set[int] | None = None) -> set[str]:
    """The likeliest letters behind the characters up to each of ``ends`` (all characters if None).

    Viterbi over the lattice, two symbols of history.
    """
    ends = {len(observed)} if ends is None else ends
    out = set()
    best: list[dict] = [{} for _ in range(len(observed) + 1)]
    best[0] = {(BOUNDARY, BOUNDARY): (0.0, None)}
    edges = lattice(observed)
    for i, states in enumerate(best):
        if i in ends and states:
            out.add(max((score + float(model[a][b][BOUNDARY]), _spelled(link)) for (a, b), (score, link) in states.items())[1])
        if i == len(observed):
            break
        for (a, b), (score, link) in states.items():
            row = model[a][b]
            for symbol, cost, used in edges[i]:
                state, value = (b, symbol), score + cost + float(row[symbol])
                there = best[i + used]
                if state not in there or there[state][0] < value:
                    there[state] = (value, (link, symbol))
        best[i] = {}
    return out


def parted(letters: str, model: np.ndarray | list) -> set[str]:
    """The words on the likeliest paths over a lattice in which each gap may be the boundary of two words.

    A word counts if the best path through its two boundaries is within MARGIN of the best of all:
    trigrams alone are too poor to trust the best one. Equal letters in a row may belong to two
    words, so keeping them is free. At worst the time grows with the square of the letters.
    """
    n, edges = len(letters), lattice(letters)
    for at, c in enumerate(letters):
        if letters[at + 1 : at + 2] == c:
            edges[at] += [(ord(x) - 97, SUBSTITUTE if c in LEET else KEEP, 1) for x in LEET.get(c, c)]
    known: dict[tuple[int, int, int], list] = {}

    def steps(at: int, a: int, b: int) -> list[tuple[int, tuple[int, int], float]]:
        if (found := known.get((at, a, b))) is None:
            found = [(at + used, (b, symbol), cost + float(model[a][b][symbol])) for symbol, cost, used in edges[at]] if at < n else []
            if b != BOUNDARY:
                found.append((at, (b, BOUNDARY), float(model[a][b][BOUNDARY])))
            known[at, a, b] = found
        return found

    # The best score from the start to each state and from it to the end; a boundary is a step at its place.
    ahead: list[dict] = [{} for _ in range(n + 1)]
    ahead[0][BOUNDARY, BOUNDARY] = 0.0
    for at in range(n + 1):
        for ends in (False, True):
            for state in [x for x in ahead[at] if (x[1] == BOUNDARY) == ends]:
                for to, then, cost in steps(at, *state):
                    ahead[to][then] = max(ahead[to].get(then, -math.inf), ahead[at][state] + cost)
    rest: list[dict] = [{} for _ in range(n + 1)]
    for at in range(n, -1, -1):
        for state in sorted(ahead[at], key=lambda x: x[1] != BOUNDARY):
            end = 0.0 if at == n and state[1] == BOUNDARY else -math.inf
            rest[at][state] = max((cost + rest[to][then] for to, then, cost in steps(at, *state)), default=end)
    least, out = rest[0][BOUNDARY, BOUNDARY] - MARGIN, set()
    for first in range(n):
        starts = {x: (y, None) for x, y in ahead[first].items() if x[1] == BOUNDARY and y + rest[first][x] >= least}
        reached, at = {first: starts} if starts else {}, first
        while reached:
            for state, (score, link) in reached.pop(at, {}).items():
                for to, then, cost in steps(at, *state):
                    if (value := score + cost) + rest[to][then] < least:
                        continue
                    if then[1] == BOUNDARY:
                        out.add(_spelled(link))
                    elif value > reached.setdefault(to, {}).get(then, (-math.inf,))[0]:
                        reached[to][then] = (value, (link, then[1]))
            at += 1
    return out


def readings(token: str, model: np.ndarray | list) -> set[str]:
    """The words that a disguised token may hide.

    Spaced letters are read as one word and as several. Marks at either end of another token are
    read as letters and as marks: at the end each number of them (of equal ones in a row one, two
    or all), at the start all, the last or none as letters.
    """
    if token[1] in _GAPS:
        return restore(token[::2], model) | parted(token[::2], model)
    lead, body = len(token) - len(token.lstrip(MARKS)), len(token.rstrip(MARKS))
    ends, run = {body, len(token)}, 0
    for at in range(body, len(token)):
        run = run + 1 if at > body and token[at - 1] == token[at] else 1
        if run <= 2 or token[at + 1 : at + 2] != token[at]:
            ends.add(at + 1)
    return {w for start in {0, max(lead - 1, 0), lead} for w in restore(token[start:], model, {e - start for e in ends})}


def disguised(lower: str) -> Iterator[str]:
    """Tokens of a lower-cased text that may hide a word: stand-ins among letters, spaced letters, long repeats."""
    if not _STAND_INS.isdisjoint(lower):
        for m in _RUN.finditer(lower):
            token, before, after = m.group(), lower[m.start() - 1 : m.start()], lower[m.end() : m.end() + 1]
            # Beside another character of a word the token ends at its mark next to it.
            if before.isalnum() or before == "_":
                token = token[min((token.find(x) % (len(token) + 1) for x in "!("), default=0) + 1 :]
            if after.isalnum() or after == "_":
                token = token[: max(token.rfind("!"), token.rfind("("), 0)]
            if len(token) > 1 and _LETTER.search(token) and not token.isalpha():
                yield token
    for m in _SPACED.finditer(lower):
        if _LETTER.search(m.group()):
            yield m.group()
    for m in _REPEATED.finditer(lower):
        yield m.group()


@dataclass
class Restorer:
    """Restores tokens under a model and remembers a bounded number of them."""

    model: np.ndarray
    seen: dict[str, set[str]] = field(default_factory=dict)

    def __post_init__(self):
        self.rows = self.model.tolist()

    def words(self, text: str) -> set[str]:
        """The distinct words of a text as it stands and of its restored tokens."""
        lower = text.lower()
        out = set(_WORD.findall(lower))
        for token in disguised(lower):
            found = self.seen.get(token)
            if found is None:
                found = readings(token, self.rows)
                if len(token) <= REMEMBERED_LENGTH:
                    if len(self.seen) > REMEMBERED:
                        self.seen.clear()
                    self.seen[token] = found
            out |= found
        return out


#: Lengths of the word beginnings that are features besides the whole word.
BEGINNINGS = (4, 5, 6, 7)


def features(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n)]


@dataclass
class Classifier:
    """Logistic regression on the presence of words and beginnings of words."""

    weights: dict[str, float]
    bias: float

    def score(self, words: set[str], known: dict[str, tuple[str, ...]]) -> float:
        """known: the weighted features of words seen before, kept by the caller between texts."""
        found: set[str] = set()
        for word in words:
            if (fs := known.get(word)) is None:
                if len(known) > REMEMBERED:
                    known.clear()
                fs = known[word] = tuple(f for f in features(word) if f in self.weights)
            if fs:
                found.update(fs)
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fit(rows: list[tuple[set[str], int]], most: int = 4000, ridge: float = 0.02, steps: int = 400) -> Classifier:
    """Features that are commoner in toxic rows, at most ``most``, weighted by gradient descent with a ridge.

    Without rows of both labels every score is the share of toxic rows, 0.0 to 1.0 (0 without rows).
    """
    positives = sum(y for _, y in rows)
    prior = (positives + 0.5) / (len(rows) + 1) if rows else 1e-6
    start = math.log(prior / (1 - prior))
    if not 0 < positives < len(rows):
        return Classifier({}, start)
    ones, zeros = Counter(), Counter()
    for words, y in rows:
        (ones if y else zeros).update({f for w in words for f in features(w)})
    least = max(3, math.ceil(0.004 * positives))
    odds = {f: math.log((n + 0.5) / (positives + 1)) - math.log((zeros[f] + 0.5) / (len(rows) - positives + 1)) for f, n in ones.items() if n >= least}
    kept = sorted((f for f, o in odds.items() if o > 2), key=lambda f: (-odds[f] * ones[f], f))[:most]
    at = {f: i for i, f in enumerate(kept)}
    y = np.array([y for _, y in rows], dtype=np.float64)
    pairs = [(i, at[f]) for i, (words, _) in enumerate(rows) for f in {f for w in words for f in features(w)} if f in at]
    w, b = np.zeros(len(kept)), start
    if pairs:
        i, j = np.array(sorted(pairs)).T
        scale = 1 / np.sqrt(np.bincount(j, minlength=len(kept)))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(b + np.bincount(i, weights=w[j], minlength=len(rows)), -30, 30)))
            g = p - y
            w -= 2 * scale * (np.bincount(j, weights=g[i], minlength=len(kept)) * scale + ridge * w)
            b -= 2 * g.mean()
    return Classifier({f: float(x) for f, x in zip(kept, w, strict=True)}, float(b))


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> tuple[Restorer, Classifier]:
    """The language model over all documents, and the classifier over a bounded sample of labelled rows.

    ``sample`` is the documented bound: the labelled rows outside the held-out fold with the
    least hashes of doc_id. Rows with a null label or text teach nothing.
    """
    restorer = Restorer(language_model(docs))
    known = labels.select("doc_id", "toxic").where("toxic is not null and doc_id is not null").where(fold_of(F.col("doc_id")) != 0)
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Restorer(restorer.model)
        for x in batches:
            yield pd.DataFrame({"toxic": x["toxic"], "w": [" ".join(sorted(own.words(t))) for t in x["text"]]})

    texts = docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").select("toxic", "text")
    rows = [(set(r["w"].split()), int(r["toxic"] > 0)) for r in texts.mapInPandas(words, "toxic int, w string").toLocalIterator()]
    return restorer, fit(rows)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 up) added; columns of those names are replaced.

    Scores come from the text alone, whole: its words, and the restored words behind disguised
    tokens. Null and empty texts get the score of no evidence. Repeated rows keep their rows,
    an empty table gives none. Scoring is one narrow pass.
    """
    restorer, classifier = train(docs, labels, sample)
    model = restorer.model

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, known = Restorer(model), {}
        for texts in batches:
            yield texts.map(lambda t: classifier.score(own.words(t or ""), known)).astype("float64")

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*kept, score(F.coalesce(F.col("text"), F.lit(""))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
