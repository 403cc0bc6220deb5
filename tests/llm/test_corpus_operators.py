"""The corpus operators against brute force, exact round trips and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspan.llm import embedding_dedup, fingerprints, line_dedup, ngram_join, packing, piece_encoding, queries, suffix_dedup, token_files, toxicity, url_filters
from quillspan.llm.common import components
from quillspan.llm.tokens import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def smallest_reachable(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (3, 3)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == smallest_reachable(set(range(41)) | set(range(100, 150)), edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1


@pytest.mark.parametrize("hot", [0, 2, 1 << 16])
def test_url_rules(spark, monkeypatch, hot):
    """Whatever number of rows makes a url hot: repeated urls and nulls keep their rows and verdicts."""
    monkeypatch.setattr(url_filters, "HOT_ROWS", hot)
    urls = [None, "", "no scheme", "http://COM/a", "https://www.Example.com/en/x?q#f", "http://example.com/en/", "http://a.example.com/en", "http://x.net/es/1", "x://net/fr/", "http://.com/", "http://a.com", "http://b.org/en/", "http://notexample.com/en/z", "http://a.com/?x://b.net/es/"]
    rows = [(i, u, "old", "old") for i, u in enumerate(urls)] + [(n, urls[n], "old", "old") for n in [3] * 40 + [0] * 20]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, rule string").repartition(5)
    got = url_filters.judge_urls(pages, queries.URL_RULES).collect()
    assert len(got) == len(rows)

    def brute(url):
        host, path = "", ""
        if url and (m := re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)):
            host, path = m[1].translate(LOWER), m[2]
        fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"

    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: brute(u) for i, u in enumerate(urls)}
    assert url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0


# --- 2


def brute_spans(rows, length):
    """For each text its bytes and which of them a repeated string covers."""
    raw = [(t or "").encode() for t in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        covered = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = True
        yield b, covered


@pytest.mark.parametrize("length", [60, 400])
def test_repeated_bytes(documents, nothing, length):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = Counter()
    for (k, _), (raw, covered) in zip(rows, brute_spans([t for _, t in rows], length), strict=True):
        kept = bytes(np.frombuffer(raw, dtype=np.uint8)[~covered])
        runs = int((np.diff(np.concatenate(([0], covered.astype(int)))) == 1).sum())
        want[(k, len(raw), int(covered.sum()), runs, kept)] += 1
    got = suffix_dedup.cut_repeats(documents, length)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == want
    assert set(got.columns) == {"doc_id", "n_bytes", "n_removed", "n_spans", "kept", "score", "n_lines"}
    assert suffix_dedup.cut_repeats(nothing, length).count() == 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("length", [400, 4096])
def test_texts_of_regular_structure_are_told_apart(spark, length):
    """Sums of powers modulo 2**64 can't tell such a text from its complement; neither repeats a long string."""
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    rng = random.Random(2)
    noise = ["".join(rng.choice("ab") for _ in range(n)) for n in (3072, 200)]
    rows = [(0, noise[0] + one + noise[1]), (1, noise[0] + two + noise[1])]
    want = {k: int(covered.sum()) for (k, _), (_, covered) in zip(rows, brute_spans([t for _, t in rows], length), strict=True)}
    got = {r.doc_id: r.n_removed for r in suffix_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()}
    assert got == want and (length == 400 or want == {0: 0, 1: 0})


@pytest.mark.parametrize(("length", "width"), [(400, 1), (403, 1), (51, 8)])
def test_overlapping_contexts_are_hashed_once(monkeypatch, length, width):
    """Keys are equal as the strings are, and stretches of a text that contexts share aren't hashed for each of them."""
    rng = random.Random(4)
    scheme = suffix_dedup.Scheme(length, width)
    some = [" ".join(rng.choices(["ab", "c", "dde", "f"], k=700)) for _ in range(3)]
    raw = scheme.raw(" ".join([*some, some[0], "x " * 900, some[1]]))
    at = np.array([p << 24 | p - a << 12 | p - b for p, a, b in scheme.anchors(raw).tolist()])[rng.randrange(2) :: 2]
    rng.shuffle(at)
    hashed, plain = [], suffix_dedup.Scheme.suffixes
    monkeypatch.setattr(suffix_dedup.Scheme, "suffixes", lambda own, raw, first, last: hashed.append((first, last)) or plain(own, raw, first, last))
    number, distance, lead, key, second = scheme.records(raw, at)
    starts = (at >> 24)[number] - distance
    assert Counter(number.tolist()) == {i: (x >> 12 & 4095) - (x & 4095) + 1 for i, x in enumerate(at.tolist())}
    strings = [scheme.cut(raw, s, s + length) for s in starts.tolist()]
    assert len(set(zip(key.tolist(), second.tolist(), strict=True))) == len({(*x, y) for *x, y in zip(key.tolist(), second.tolist(), strings, strict=True)}) == len(set(strings)) < len(strings)
    assert lead.tolist() == [int.from_bytes(x[:8], "big" if width == 1 else "little") for x in strings]
    ordered = sorted(hashed)
    assert all(b >= a + length for (_, a), (b, _) in zip(ordered, ordered[1:], strict=False)) and len(hashed) < len(at)


def brute_passages(texts, words):
    """(text left, words, words cut) of each text, from the runs of words of all texts."""
    found = [list(WORD.finditer(t or "")) for t in texts]
    seen = Counter(tuple(m.group() for m in w[i : i + words]) for w in found for i in range(len(w) - words + 1))
    for text, w in zip(texts, found, strict=True):
        cut = [False] * len(w)
        for i in range(len(w) - words + 1):
            if seen[tuple(m.group() for m in w[i : i + words])] > 1:
                cut[i : i + words] = [True] * words
        out, at = "", 0
        for i, m in enumerate(w):
            if cut[i]:
                if not (i and cut[i - 1]):
                    out += text[at : m.start()]
                at = m.end()
        yield None if text is None else out + text[at:], len(w), sum(cut)


@pytest.mark.parametrize("words", [32, 51])
def test_repeated_passages(documents, nothing, words):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = Counter((k, *x) for (k, _), x in zip(rows, brute_passages([t for _, t in rows], words), strict=True))
    got = suffix_dedup.cut_passages(documents, words)
    assert Counter((r.doc_id, r.text, r.n_words, r.n_cut) for r in got.collect()) == want and sum(x[3] > 0 for x in want) > 5
    assert set(got.columns) == {*documents.columns, "n_words", "n_cut"} and suffix_dedup.cut_passages(nothing, words).count() == 0


# --- 3, 8


def library_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    return np.array([*(t.encode(text or "", add_special_tokens=False).ids), 0], dtype="<u4")


def test_an_added_token_in_a_text_is_one_id():
    from tokenizers import Tokenizer

    from quillspan.llm.tokens import Encoder

    library = Tokenizer.from_file(vocabulary_path())
    texts = ["x<|endoftext|>y", "<|endoftext|>", "x <|endoftext|> é\n", "日<|endoftext|>", "<|endoftext", "plain"]
    got = [x.tolist() for x in Encoder(vocabulary_path()).encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts] and got[0] == [87, 50256, 88]


def test_packing(spark, documents, nothing):
    got = packing.pack(packing.token_pieces(documents, vocabulary_path(), 256), 256).toPandas()
    whole = {r.doc_id: library_ids(r.text) for r in documents.collect() if r.doc_id is not None}
    for r in got[got.doc_id.notna()].itertuples():
        assert zlib.crc32(whole[int(r.doc_id)][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.length == 256 or len(whole[int(r.doc_id)]) <= 256 or r.piece == 0
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by.length.sum() <= 256).all() and all((g.offset == g.length.cumsum() - g.length).all() for _, g in by)
    total = sum(len(library_ids(r.text)) for r in documents.collect())
    assert got.length.sum() == total and got.sequence_id.nunique() <= math.ceil(total / 256) + 2
    assert packing.pack(packing.token_pieces(nothing, vocabulary_path(), 256), 256).count() == 0


def test_packing_many_rounds(spark):
    rng = random.Random(9)
    sizes = [(i, rng.choice([1, 5, 300, 500, 700, 1024, 1500, 2048])) for i in range(3000)]
    got = packing.pack(spark.createDataFrame(sizes, "id long, length long").repartition(40), 2048).toPandas()
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by.length.sum() <= 2048).all() and all((g.offset == g.length.cumsum() - g.length).all() for _, g in by)
    at_once = packing.best_fit(np.array([s for _, s in sizes]), 2048)[0].max() + 1
    assert sorted(got.id) == list(range(3000)) and got.sequence_id.nunique() <= 1.03 * at_once


def test_token_files(spark, documents, nothing):
    manifest = token_files.write_token_files(documents, vocabulary_path())
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_files.digest_token_files(manifest).collect())
    want, start = [], 0
    for known, k, text in sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in documents.collect()):
        ids = library_ids(text)
        want.append((known, k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    full = {r.doc_id: r.ids for r in token_files.read_token_files(manifest).collect()}
    assert full[66] == library_ids(documents.where("doc_id = 66").first().text).tolist()
    assert token_files.write_token_files(nothing, vocabulary_path()).count() == 0


def test_token_file_reads_only_what_is_asked(tmp_path):
    writer = token_files.Writer(f"file://{tmp_path}/a.ids.zst")
    for k in range(200):
        writer.add(k, np.arange(k, k + 2000, dtype="<u4"))
    writer.close()
    reader = token_files.Reader(f"file://{tmp_path}/a.ids.zst")
    [(k, before, ids)] = list(reader.documents({150}))
    assert (k, before, ids.tolist(), reader.frames_read) == (150, 150 * 2000, list(range(150, 2150)), 1)
    raw = bytearray((tmp_path / "a.ids.zst").read_bytes())
    raw[30] ^= 255
    (tmp_path / "b.ids.zst").write_bytes(bytes(raw))
    with pytest.raises(Exception):  # noqa: B017
        list(token_files.Reader(f"file://{tmp_path}/b.ids.zst").documents())


# --- 4


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_jaccard_components(documents, nothing, words, percent):
    rows = [(r.doc_id, r.text) for r in documents.collect()]

    def shingles(text):
        w = WORD.findall((text or "").translate(LOWER))
        return frozenset(zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else frozenset([tuple(w)] if w else [])

    sets = {k: shingles(t) for k, t in rows if k is not None}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    assert len(linked) > 5
    want = Counter((k, len(shingles(t)), None if k is None else smallest_reachable(sets, linked)[k]) for k, t in rows)
    got = ngram_join.similar_documents(documents, words, percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want
    assert ngram_join.similar_documents(nothing, words, percent).count() == 0


def test_words_of_regular_structure_are_told_apart(spark):
    one = thue_morse(1024)
    rows = [(0, one), (1, one.translate(str.maketrans("ab", "ba"))), (2, one)]
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


# --- 5


def test_words_are_spelled_together_and_keys_stay_whole(spark):
    """The ids of many words at once are those of each, and of the library; large doc_ids beside a null one stay as they are."""
    import sentencepiece

    path = piece_encoding.model_path()
    library, pieces = sentencepiece.SentencePieceProcessor(model_file=path), piece_encoding.Pieces(path)
    words = ["\u2581document", "\u2581zzyqvx", "\u2581na\u00efve\u4e00\U0001f600"]
    found = piece_encoding.paths(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), pieces).collect()
    ids = pieces.spell([r.word for r in found], np.array([r.mask for r in found]))
    assert {r.word: np.frombuffer(x, dtype="<u4").tolist() for r, x in zip(found, ids, strict=True)} == {w: library.encode(w[1:]) for w in words}
    assert ids == [pieces.word(r.word, r.mask) for r in found] and pieces.spell([], np.zeros(0, dtype=np.int64)) == []
    texts = ["naïve \U0001f600 words", "", "one  two\n"]
    encoded = [np.array(library.encode(t), dtype="<u4") for t in texts]
    assert piece_encoding.decode(encoded, pieces) == texts and piece_encoding.decode([], pieces) == [] and piece_encoding.decode(encoded[1:2], pieces) == [""]
    rows = [(2**53 + 1, "one"), (None, "two"), (2**53 + 3, "three")]
    keyed = piece_encoding.encode_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path)
    assert {r.doc_id: r.ids for r in keyed.collect()} == {k: library.encode(t) for k, t in rows}


def test_pieces_as_the_library_has_them(documents, nothing):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_encoding.model_path())
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    got = {r.doc_id: r.ids for r in piece_encoding.encode_documents(documents, piece_encoding.model_path()).collect()}
    assert got == {k: library.encode(t) for k, t in texts.items()}
    for r in piece_encoding.digest_documents(documents, piece_encoding.model_path()).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_pieces == len(got[r.doc_id])
    assert piece_encoding.encode_documents(nothing, piece_encoding.model_path()).count() == 0


def test_pieces_of_joined_and_shuffled_files(spark, texts, tmp_path):
    """Rows whose split can't be told are written down: files that are joined, shuffled, united or limited."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_encoding.model_path())
    rows = [(i, t) for i, t in texts.items() if i < 20 or i > 57]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(i,) for i, _ in rows], "doc_id long").write.parquet(f"{tmp_path}/ids")
    docs, ids = spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/ids")
    want = {i: library.encode(t or "") for i, t in rows}
    assert piece_encoding._plain_scan(docs.where("doc_id >= 0").select("doc_id", "text"))
    for made in (docs.join(ids, "doc_id"), docs.repartition(3), docs.where("doc_id < 9").union(docs.where("doc_id >= 9"))):
        assert not piece_encoding._plain_scan(made)
        assert {r.doc_id: r.ids for r in piece_encoding.encode_documents(made, piece_encoding.model_path()).collect()} == want


def test_long_words_go_through_the_lattice(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_encoding.model_path())
    rng = random.Random(13)
    letters = "etaoinshrdlucmfwypvbgkqjxz"
    texts = ["".join(rng.choice(letters[:k]) for _ in range(n)) for k, n in ((4, 500), (12, 3000), (26, 20_000), (2, 700))]
    texts += ["a" * 4000, "the" * 900, "日本語のテキスト" * 400, "aGVsbG8gd29ybGQ" * 300 + " tail", "x" * 63, "x" * 62, "  " + "internationalization" * 20 + "\n" + "e" * 99, " " * 500, "ab " * 3000]
    got = {r.doc_id: r.ids for r in piece_encoding.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), piece_encoding.model_path()).collect()}
    assert got == {k: library.encode(t) for k, t in enumerate(texts)}


# --- 6


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 24))
    rows = [(i, base[i % 30] + rng.normal(size=24) * rng.choice([0.02, 0.2, 0.4])) for i in range(300)] + [(300, base[0] * 7), (301, base[0])]
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in rows]
    rows += [(400, None), (401, [0.0] * 24), (402, [float("nan")] + [1.0] * 23), (403, [None] * 24), (404, []), (405, [1.0, 0.0]), (406, [2.0, 0.0]), (None, rows[0][1]), (5, rows[5][1])]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("kept", F.lit(1)), 0.95).collect()
    usable = [(k, np.array(v, dtype=np.float64)) for k, v in rows if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, count = [], defaultdict(int)
    for i, (a, x) in enumerate(usable):
        for j, (b, y) in enumerate(usable):
            if i != j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                links.append((a, b))
                count[i] += 1
    want = smallest_reachable({k for k, _ in rows if k is not None}, [x for x in links if x[0] != x[1]])
    per_row = Counter((k, count[i], want[k], want[k] == k) for i, (k, _) in enumerate(usable))
    per_row += Counter((k, 0, k, k is not None) for k, v in rows if not any(k == u for u, _ in usable))
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == per_row
    assert len(links) > 300
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("axes", [1, 2, 3])
def test_near_vectors_on_grids_of_more_axes(spark, monkeypatch, axes):
    monkeypatch.setattr(embedding_dedup, "grid_axes", lambda n: axes)
    rng = np.random.default_rng(axes)
    base = rng.normal(size=(40, 16))
    v = np.vstack([base[i % 40] + rng.normal(size=16) * rng.choice([1e-9, 0.1, 0.3, 3.0]) for i in range(600)])
    got = embedding_dedup.near_vectors(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), 0.95).collect()
    u = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    want = smallest_reachable(range(600), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)])
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(near[i].sum()), want[i]) for i in range(600)}


# --- 7


def test_edit_distance_by_bits():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("ABC") for _ in range(rng.randint(0, 70))) for _ in range(2))
        assert fingerprints.edit_distance(a, b) == slow(a, b)


def plain_fingerprint(data):
    """The fingerprint as its docstring says, byte by byte."""
    mask, digits = 2**64 - 1, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def stir(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    rolled = [stir(sum(data[i - back] << 7 * back for back in range(7) if back <= i) & mask) >> 32 for i in range(len(data))]

    def pieces(size):
        out, start = [], 0
        for i, r in enumerate(rolled):
            if r % size == size - 1:
                out.append(data[start : i + 1])
                start = i + 1
        return out, data[start:]

    size = 3
    while size * 64 < len(data):
        size *= 2
    while size > 3 and len(pieces(size)[0]) < 32:
        size //= 2
    signs = ["".join(digits[zlib.crc32(x) >> 26] for x in [*done, *([rest] if rest else [])]) for done, rest in (pieces(size), pieces(2 * size))]
    return f"{size}:{signs[0]}:{signs[1]}"


def plain_likeness(left, right):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    if left == right:
        return 1.0
    (a, *sa), (b, *sb) = left.split(":"), right.split(":")
    sizes_a, sizes_b = {int(a): sa[0], 2 * int(a): sa[1]}, {int(b): sb[0], 2 * int(b): sb[1]}
    both = [(sizes_a[k], sizes_b[k]) for k in sizes_a.keys() & sizes_b.keys()]
    return max([0.0, *(1 - distance(x, y) / max(len(x), len(y)) for x, y in both if x or y)])


def test_fingerprints_and_likeness_byte_by_byte():
    rng = random.Random(12)
    samples = [b"", b"a", b"aaaa" * 500, bytes(range(256)) * 20, "日本語 é".encode() * 60]
    samples += [bytes(rng.choice(b"abcdefgh \n") for _ in range(rng.choice([5, 100, 700, 4000]))) for _ in range(20)]
    for x in list(samples[5:]):
        edit = bytearray(x)
        for _ in range(3):
            edit[rng.randrange(len(edit))] = rng.randrange(256)
        samples += [bytes(edit), x[: len(x) // 2] + samples[-1][: len(x) // 3]]
    prints = [fingerprints.fingerprint(x) for x in samples]
    assert prints == [plain_fingerprint(x) for x in samples]
    scores = [(fingerprints.likeness(x, y), plain_likeness(x, y)) for x in prints[:30] for y in prints[20:60]]
    assert all(a == b for a, b in scores) and len({a for a, _ in scores}) > 30


def test_fingerprints_of_edited_texts(documents, texts, nothing):
    got = fingerprints.compare_with_edits(documents).collect()
    order = sorted(((k is not None, k or 0), t or "") for k, t in ((r.doc_id, r.text) for r in documents.collect()))
    assert len(got) == len(order)
    seen = {}
    for (key, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        own, new, following = (fingerprints.fingerprint(t.encode()) for t in (text, edited, after))
        seen[key, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, new, fingerprints.likeness(own, new), fingerprints.likeness(own, following)] = 1
    for r in got:
        assert ((r.doc_id is not None, r.doc_id or 0), *tuple(r)[1:]) in seen
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for r in got if r.n_chars > 400 and r.doc_id < 40]
    assert np.mean([r.near_edited for r in long]) > 0.5 > np.mean([r.near_next for r in long])
    assert fingerprints.compare_with_edits(nothing).count() == 0
    assert fingerprints.add_fingerprints(documents).where("doc_id in (3, 46)").select("fingerprint").distinct().count() == 1


# --- 9


def test_lines(documents, nothing):
    rows = {r.doc_id: r.text for r in documents.collect()}
    firsts, lines = {}, []
    for k in sorted(rows, key=lambda k: (k is not None, k or 0)):
        for i, line in enumerate(rows[k].split("\n") if rows[k] is not None else []):
            bare = line.lower().strip(" \t\n\x0b\x0c\r")
            if bare:
                lines.append(((k is not None, k or 0, i), bare))
                firsts.setdefault(bare, (k is not None, k or 0, i))

    def shingles(bare):
        w = WORD.findall(bare)
        return set(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)}

    sets = [(at, shingles(b)) for b, at in firsts.items()]
    gone = {at for at, b in lines if firsts[b] != at} | {a for a, s in sets for b, t in sets if b < a and 5 * len(s & t) >= 4 * len(s | t)}
    dropped = {at for at, b in lines if firsts[b] in gone} | gone
    dropped = {at for at, b in lines if at != firsts[b] or at in gone}
    got = line_dedup.dedup_lines(documents)
    assert got.columns == ["doc_id", "text", "score", "kept", "n_lines", "n_removed"][:4] + ["n_lines", "n_removed"]
    for r in got.collect():
        text = rows[r.doc_id]
        if text is None:
            assert (r.text, r.n_lines, r.n_removed) == (None, 0, 0)
            continue
        parts = text.split("\n")
        kept = [x for i, x in enumerate(parts) if (r.doc_id is not None, r.doc_id or 0, i) not in dropped]
        assert (r.text, r.n_lines, r.n_removed) == ("\n".join(kept), len(parts), len(parts) - len(kept))
    assert got.count() == documents.count() and line_dedup.dedup_lines(nothing).count() == 0


def test_lines_go_by_their_own_row_only(spark):
    """Rows that share a doc_id, or have none, are documents of their own unless their texts are equal as well."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [line(12) for _ in range(6)]
    rows = [(None, "alpha one\nbeta two\ngamma three"), (7, "keep me zero\nkeep me one"), (1, "alpha one\nother words"), (None, "alpha one\nnew one\nsecond\nalpha one"), (7, "alpha one\nalpha one"), (7, None), (7, ""), (None, None)]
    for k in (None, 3, 3, 7, 8, 8, None):
        rows.append((k, "\n".join(rng.choice([rng.choice(shared), line(10), rng.choice(shared).replace(" ", "  ", 1), f"{rng.choice(shared)} end"]) for _ in range(5))))
    rows += [rows[3], rows[9], rows[9]]
    order = {x: i for i, x in enumerate(sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())))}
    lines, seen = [], {}
    for (k, t), at in order.items():
        for i, x in enumerate(t.split("\n") if t is not None else []):
            if bare := x.lower().strip(" \t\n\x0b\x0c\r"):
                lines.append((at, i, bare))
    shingles = lambda b: set(zip(*(WORD.findall(b)[i:] for i in range(5)), strict=False)) if len(WORD.findall(b)) > 4 else {tuple(WORD.findall(b))}
    firsts = {}
    for at, i, bare in lines:
        firsts.setdefault(bare, (at, i))
    gone = set()
    for at, i, bare in lines:
        first = firsts[bare]
        near = any(firsts[other] < first and 5 * len(shingles(bare) & shingles(other)) >= 4 * len(shingles(bare) | shingles(other)) for other in firsts)
        if (at, i) != first or near:
            gone.add((at, i))
    want = Counter((k, t, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (order[k, t], i) not in gone)) for k, t in rows)
    docs = spark.createDataFrame([(k, t, t) for k, t in rows], "doc_id long, text string, whole string").repartition(3)
    assert Counter((r.doc_id, r.whole, r.text) for r in line_dedup.dedup_lines(docs).collect()) == want
    left = {(r.doc_id, r.whole): r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert "gamma three" in left[rows[0]] and left[rows[1]] == rows[1][1]


def test_near_lines_go_in_crowded_lists(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for _, t in rows]
    assert got == {i: int(any(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(i))) for i in range(150)}


def test_lines_of_many_words_and_crowded_lists(spark):
    """A line of 20,000 words beside an edit of it, and some 300 variants around one line, many just below the threshold."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(7)) for _ in range(4000)]
    long = [rng.choice(words) for _ in range(20_000)]
    edited = list(long)
    for i in range(0, 20_000, 60):
        edited[i] = "edited"
    far = list(long)
    for i in range(0, 20_000, 20):
        far[i] = "far"
    rows = [(0, " ".join(long)), (1, " ".join(edited)), (2, " ".join(far))]
    base = [rng.choice(words) for _ in range(50)]
    for i in range(3, 300):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 2, 3, 3])):
            copy[rng.randrange(50)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for _, t in rows]
    assert got == {i: int(any(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(i))) for i in range(len(rows))}
    assert (got[1], got[2]) == (1, 0)


def test_line_dedup_is_native(documents):
    assert "Python" not in line_dedup.dedup_lines(documents)._jdf.queryExecution().executedPlan().toString()


def test_tables_of_all_lines_go_with_the_index(spark, documents, monkeypatch):
    """Once lines are indexed, neither they nor their leading tokens take room, and no tokens of all lines are shuffled."""
    from pathlib import Path

    from quillspan.llm.common import shared_dir

    shared = Path(shared_dir(spark).removeprefix("file:"))
    held = lambda: {p.name for p in shared.glob("*") if p.name.startswith(("lines-", "first-lines-"))}
    before, seen, led = held(), [], line_dedup._led
    monkeypatch.setattr(line_dedup, "_led", lambda *a: seen.append(held() - before) or led(*a))
    assert line_dedup.dedup_lines(documents).count() == documents.count() and seen == [set()]


# --- 10


def test_disguised_words_are_restored():
    rng = random.Random(1)
    plain = "idiot moron stupid worthless pathetic trash loser clown scum the and of thing with".split()
    counts = toxicity.trigram_counts(" ".join(rng.choice(plain) for _ in range(50)) for _ in range(200)).reshape((toxicity.SYMBOLS,) * 3) + 0.5
    model = np.log(counts / counts.sum(axis=2, keepdims=True))
    for token, word in [("1d10t", "idiot"), ("m0r0n", "moron"), ("l o s e r", "loser"), ("s.c.u.m", "scum"), ("idiooot", "idiot"), ("w0rthl3ss", "worthless"), ("tr@sh", "trash"), ("$tup1d", "stupid"), ("c-l-o-w-n", "clown")]:
        assert word in toxicity.Restorer(model).words(f"You {token} there"), token


def test_restored_letters_are_the_best_of_all_paths():
    """Viterbi against every path of the lattice, scored one by one."""
    rng = random.Random(3)
    plain = "idiot moron stupid loser scum the and of thing".split()
    counts = toxicity.trigram_counts(" ".join(rng.choice(plain) for _ in range(50)) for _ in range(100)).reshape((toxicity.SYMBOLS,) * 3) + 0.5
    model = np.log(counts / counts.sum(axis=2, keepdims=True))

    def paths(edges, at, spelled, score):
        if at == len(edges):
            yield spelled, score
        else:
            for symbol, cost, used in edges[at]:
                if at + used <= len(edges):
                    yield from paths(edges, at + used, [*spelled, symbol], score + cost)

    for _ in range(150):
        token = "".join(rng.choice("aeilost013457$@!l") * rng.choice([1, 1, 1, 2, 3, 4]) for _ in range(rng.randint(1, 4)))
        scores = {}
        for spelled, cost in paths(toxicity.lattice(token), 0, [], 0.0):
            known = [toxicity.BOUNDARY, toxicity.BOUNDARY, *spelled, toxicity.BOUNDARY]
            total = cost + sum(float(model[a][b][c]) for a, b, c in zip(known, known[1:], known[2:]))
            word = "".join(chr(97 + s) for s in spelled)
            scores[word] = max(total, scores.get(word, -math.inf))
        (found,) = toxicity.restore(token, model)
        assert scores[found] >= max(scores.values()) - 1e-9, token


def test_disguised_words_of_any_length_are_restored():
    rng = random.Random(1)
    plain = "idiot idiots moron stupid worthless asshole shit ass loser a an the and of thing with".split()
    counts = toxicity.trigram_counts(" ".join(rng.choice(plain) for _ in range(50)) for _ in range(200)).reshape((toxicity.SYMBOLS,) * 3) + 0.5
    restorer = toxicity.Restorer(np.log(counts / counts.sum(axis=2, keepdims=True)))
    cases = {"1d107": "idiot", "1d1075": "idiots", "@55h0l3": "asshole", "$h!7": "shit", "a$$": "ass", "a$$!!": "ass", "!d10t": "idiot", "(1d10t": "idiot", "i d 1 o t !": "idiot"}
    cases |= {"idi" + "o" * 44 + "t": "idiot", "1d1" + "0" * 26 + "t": "idiot", "a l o s e r": "loser", "a.s.s": "ass"}
    cases |= {" ".join("worthlessstupididiots"): "worthless stupid idiots", "-".join("theloser" * 20): "the loser"}
    for token, words in cases.items():
        assert set(words.split()) <= restorer.words(f"You {token} there"), token
    assert not list(toxicity.disguised("1 2 3 4 2024 10,000 plain words only"))
    for text in ("!" * 20000 + "a é", "a" * 20000 + "é", "1d10" * 5000, "a " * 5000):
        assert restorer.words(text)


def test_toxicity_on_held_out_rows(spark, nothing):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 5 == 2
        text = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["blarghy", "snorkfool"]) + rng.choice(["", "ing", "ed"]))
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    rows += [(2000, None, "x"), (2001, "", "x"), (2002, "you bl4rghy thing", "x"), (None, "hello", "x"), (7, rows[7][1], "x")]
    got = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    truth = dict(labels)
    held = got[got.doc_id.map(lambda k: k == k and k < 1500 and zlib.crc32(str(int(k)).encode()) % 5 == 0)]
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.98
    by = got.drop_duplicates("doc_id").set_index("doc_id").predicted
    assert by[2000] == by[2001] == 0 and by[2002] == 1
    assert toxicity.score_toxicity(nothing, spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


# --- the pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    clean = pipeline.drop_toxic(spark, docs, sf)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()
    ids = {r.doc_id for r in pipeline.drop_lines(spark, docs, sf).select("doc_id").collect()}
    assert ids == {r.doc_id for r in docs.select("doc_id").collect()}
    kept = pipeline.drop_copies(spark, docs, sf)
    want = ngram_join.similar_documents(docs, 5, 80).where("component_id = doc_id").count()
    assert kept.count() == want and kept.columns == docs.columns
    cut = {r.doc_id: (r.text, r.n_chars) for r in pipeline.cut_passages(spark, kept, sf).collect()}
    rows = kept.select("doc_id", "text").collect()
    left = {r.doc_id: (text, len(text)) for r, (text, n, gone) in zip(rows, brute_passages([r.text for r in rows], pipeline.PASSAGE_WORDS), strict=True) if not gone or gone < n}
    assert cut == left and len(left) <= len(rows)
    assert isinstance(pipeline.run(spark, sf).toPandas(), pd.DataFrame)


def test_no_stage_pipes_python_into_python(spark, sf, monkeypatch):
    """A task of the pipeline needs one Python worker: two in a row double the workers that an executor holds from then on."""
    import corpus_pipeline as pipeline
    from quillspan.llm import common

    plans = []

    def kept(df, *args, **more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.written(df, *args, **more)

    for module in (ngram_join, packing, suffix_dedup):
        monkeypatch.setattr(module, "written", kept)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for stage in (pipeline.drop_copies, pipeline.cut_passages, pipeline.pack_sequences):
        plans.append(stage(spark, docs, sf)._jdf.queryExecution().executedPlan().toString())
    chained = re.compile(r"(?:ArrowEvalPython|MapInPandas)(?:(?!Exchange|Join|Union)[\s\S])*?(?:ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas) ")
    nodes = [[re.sub(r"^[\s:+*()0-9-]+", "", line).split(" ")[0] for line in p.split("\n")] for p in plans]
    assert sum("MapInPandas" in n or "ArrowEvalPython" in n for n in nodes) > 5
    assert not [n for n in nodes if chained.search(" ".join(n) + " ")]


def test_every_repeated_passage_of_over_50_words_is_cut(spark, sf):
    import corpus_pipeline as pipeline

    rng = random.Random(3)
    rows = []
    for length in (1, 2, 3):
        passage = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(length)) for _ in range(51))
        rows += [(10 * length + i, f"{chr(65 + i) * 40} {passage} {chr(75 + i) * 40}", "en", "x", 1) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cut = {r.doc_id: r.text for r in pipeline.cut_passages(spark, docs, sf).collect()}
    assert cut == {10 * length + i: f"{chr(65 + i) * 40}  {chr(75 + i) * 40}" for length in (1, 2, 3) for i in range(2)}
    alone = spark.createDataFrame([(1, passage, "en", "x", 1), (2, f"{passage} more", "en", "x", 1), (3, " ", "en", "x", 1), (4, None, "en", "x", 1)], docs.schema)
    assert {r.doc_id: r.text for r in pipeline.cut_passages(spark, alone, sf).collect()} == {2: " more", 3: " ", 4: None}


def test_stages_on_repeated_ids_nulls_and_copies(spark, sf):
    import corpus_pipeline as pipeline

    rng = random.Random(21)
    prose = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)) for _ in range(6)]
    both = f"{prose[0]}\n{prose[1]}"
    rows = [(1, both), (2, both), (3, f"{prose[0]}\n{prose[2]}"), (4, prose[3]), (4, prose[4]), (4, prose[4]), (5, None), (6, ""), (None, prose[5]), (None, prose[5])]
    docs = spark.createDataFrame([(k, t, "en", "x", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    lines = Counter((r.doc_id, r.text) for r in pipeline.drop_lines(spark, docs, sf).collect())
    # 2 would be emptied and goes whole to the join; 3 loses the line that 1 has.
    assert lines[2, both] == 1 and lines[3, prose[2]] == 1 and lines[5, None] == 1 and lines[6, ""] == 1 and sum(lines.values()) == len(rows)
    kept = Counter((r.doc_id, r.text) for r in pipeline.drop_copies(spark, docs, sf).collect())
    assert kept == Counter({(1, both): 1, (3, rows[2][1]): 1, (4, prose[3]): 1, (4, prose[4]): 1, (5, None): 1, (6, ""): 1, (None, prose[5]): 2})
    for name, stage in pipeline.STAGES[1:4]:
        empty = stage(spark, docs.where("false"), sf)
        assert empty.columns == docs.columns and empty.count() == 0, name


def test_bins_left_behind_never_cost_a_sequence():
    """Rounds that carry FAN_IN bins a round make as many sequences as rounds that carry every bin that is not full."""
    rng, capacity = np.random.default_rng(7), 64

    def sequences(groups, carried):
        count, level = 0, [np.bincount(b := packing.best_fit(g, capacity)[0], weights=g).astype(int) for g in groups]
        while True:
            opened = [packing.still_open(x, capacity, carried) for x in level]
            count += sum(int((~o).sum()) for o in opened)
            left = [x[o] for x, o in zip(level, opened, strict=True)]
            if len(left) == 1:
                return count + len(left[0])
            joined = [np.concatenate(left[i : i + 2]) for i in range(0, len(left), 2)]
            level = [np.bincount(packing.best_fit(f, capacity)[0], weights=f).astype(int) if len(f) else f for f in joined]

    for case in range(400):
        # Sizes over half, sizes of a few ids and sizes just under the gaps, which best fit has to hold apart.
        pools = [np.arange(33, 65), np.arange(1, 8), np.arange(20, 33), np.arange(1, 65)]
        groups = [rng.choice(pools[int(rng.integers(4)) if case % 2 else case // 2 % 4], int(rng.integers(1, 60))) for _ in range(8)]
        assert sequences(groups, 2 * 3) == sequences(groups, 10**6)
