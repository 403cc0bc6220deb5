"""SentencePiece encoding and decoding by a relational lattice of pieces.

Texts fall into words that no piece crosses. The different words are exploded into substrings
of bounded length, which meet the piece table in an equi-join; the edges that remain are
grouped by word, and a fold of Spark's higher-order functions picks the path. The public model
is a BPE model, whose path is not the one of the greatest total score: the fold merges, again
and again, the best-scored edge over two neighbouring symbols, the leftmost of equals. (For a
unigram model the same edges would be folded by Viterbi.) Symbols without a piece become bytes.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from hashlib import md5, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import forget, fresh_path, partitions, written
from quillspan.llm.token_files import filesystem

SPACE = "▁"
#: The path of a word up to so long is the bits of one long; that of a longer one is a list of its symbols' starts.
LONGEST = 62
#: Substrings of long words that a task hands on at a time, and bytes of a row group of paths.
SPANS_AT_ONCE, ROW_GROUP = 50_000, 4 << 20
#: Words of the most splits, whose paths every task reads; the others' paths go to the splits that have them.
COMMON = 150_000
#: Different chunks of text that a task gathers before it passes their words on, and chunks whose ids a task remembers.
COUNTED_AT_ONCE, REMEMBERED = 800_000, 800_000
#: Words of all splits, repeats included, that one partition gathers edges of.
WORDS_IN_PART = 100_000


_CHUNK = re.compile(" +[^ ]*")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The model's pieces by string, and its byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.vocab_size()
        self.rows = [(self.library.id_to_piece(i), i, float(self.library.get_score(i))) for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        self.ids = {piece: i for piece, i, _ in self.rows}
        self.byte = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(len(piece) for piece, _, _ in self.rows)
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.pattern = re.compile(self._words())
        strings = {i: piece.replace(SPACE, " ").encode() for piece, i, _ in self.rows} | {i: bytes([b]) for b, i in enumerate(self.byte)}
        self.table, self.numbers = pa.array([p for p, _, _ in self.rows], pa.string()), np.array([i for _, i, _ in self.rows], dtype="<u4")
        self.strings = pa.array([strings.get(i) for i in range(n)], pa.binary())

    def _words(self) -> str:
        """A pattern of words that no piece crosses.

        Blanks begin a word, line feeds stand alone, and a letter is cut from a mark behind it,
        for those marks that no piece has behind a letter.
        """
        pairs = self.pairs
        if any("\n" in x or (x[1] == SPACE and x[0] != SPACE) for x in pairs):
            raise ValueError("a piece crosses words")
        letter = "A-Za-zÀ-ÖØ-öø-ɏ"
        bound = {x[1] for x in pairs if re.match(f"[{letter}]", x)}
        self.marks = frozenset(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in bound)
        marks = "".join(map(re.escape, sorted(self.marks)))
        plain, whole = f"{SPACE}*[{letter}]+", f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"
        if not marks:
            return whole
        return f"{plain}(?=[{marks}{SPACE}\n])|{SPACE}*[^{SPACE}\n]*?[{letter}](?=[{marks}])|{whole}"

    @staticmethod
    def chunks(text: str) -> list[str]:
        """A text, with a blank before it, cut before every run of blanks; one blank of each run is left out. No word crosses them."""
        if not text:
            return []
        if "  " in text or text[0] == " ":
            return [x[1:] for x in _CHUNK.findall(" " + text)]
        return text.split(" ")

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk behind its blank. Long ones are cut wherever no piece has the two characters together."""
        if len(chunk) < LONGEST:
            # What the pattern gives for letters, with or without one mark behind them.
            if chunk.isalpha():
                return [SPACE + chunk]
            if chunk[-1:] in self.marks and chunk[:-1].isascii() and chunk[:-1].isalpha():
                return [SPACE + chunk[:-1], chunk[-1]]
        found = self.pattern.findall(SPACE + chunk.replace(" ", SPACE))
        if len(chunk) < LONGEST:
            return found
        return [part for w in found for part in (self._parts(w) if len(w) > LONGEST else (w,))]

    def _parts(self, word: str) -> Iterator[str]:
        start = 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.pairs:
                yield word[start:i]
                start = i
        yield word[start:]

    def word(self, word: str, mask: int) -> bytes:
        """Ids of a word whose symbols begin at the bits of ``mask``, as little-endian 32-bit integers."""
        if mask == 1 | 1 << len(word):
            return self.ids[word].to_bytes(4, "little")
        cuts, rest = [], mask & ~1
        while rest:
            low = rest & -rest
            cuts.append(low.bit_length() - 1)
            rest ^= low
        return self.symbols(word, cuts)

    def spell(self, words: list[str], masks: np.ndarray) -> list[bytes]:
        """``word`` of many words at once: the symbols of all of them, one behind the other, are looked up together."""
        text, sizes = "".join(words).encode(), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        places = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) & 0xC0 != 0x80)
        row, at = np.nonzero(np.unpackbits(masks.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        begins = at < sizes[row]
        row, at = row[begins], at[begins]
        starts = np.append(places[(np.cumsum(sizes) - sizes)[row] + at], len(text)).astype(np.int32)
        found = pc.index_in(pa.StringArray.from_buffers(len(row), pa.py_buffer(starts), pa.py_buffer(text)), value_set=self.table).fill_null(-1).to_numpy()
        ids, ends = self.numbers[found].tobytes(), 4 * np.cumsum(np.bincount(row, minlength=len(words)))
        out = [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)]
        for i in np.unique(row[found < 0]).tolist():
            out[i] = self.word(words[i], int(masks[i]))
        return out

    def symbols(self, word: str, stops: list[int]) -> bytes:
        """Ids of a word whose symbols end at ``stops``; a symbol without a piece becomes bytes."""
        out, start = array("I"), 0
        for stop in stops:
            piece = word[start:stop]
            found = self.ids.get(piece)
            if found is None:
                out.extend(self.byte[x] for x in piece.encode())
            else:
                out.append(found)
            start = stop
        return out.tobytes()


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _ranks(pieces: Pieces) -> list[tuple[str, int]]:
    order = {score: rank for rank, score in enumerate(sorted({score for p, _, score in pieces.rows if len(p) > 1}, reverse=True))}
    return [(p, order[score]) for p, _, score in pieces.rows if len(p) > 1]


def fold_long(edges: np.ndarray) -> list[int]:
    """Where the symbols of a long word end behind which edges begin: the same fold as for short words, with a heap.

    ``edges`` are sorted numbers of rank, start and length as ``long_paths`` packs them.
    """
    rank = {(e >> 6 & 0xFFFFFFFF, (e >> 6 & 0xFFFFFFFF) + (e & 63)): e >> 38 for e in edges.tolist()}
    size = max(stop for _, stop in rank)
    after, before = list(range(1, size + 2)), list(range(-1, size + 1))
    whole = bytearray([1]) * (size + 1)
    heap = [(r, a, b) for (a, b), r in rank.items() if b - a == 2]
    heapq.heapify(heap)
    while heap:
        _, a, b = heapq.heappop(heap)
        if not whole[a] or after[a] >= b or after[after[a]] != b:
            continue
        whole[after[a]] = 0
        after[a], before[b] = b, a
        for x, y in ((before[a], b), (a, after[b])):
            if x >= 0 and y <= size and (x, y) in rank:
                heapq.heappush(heap, (rank[x, y], x, y))
    return [i for i in range(1, size + 1) if whole[i]]


def long_paths(words: DataFrame, pieces: Pieces, path: str) -> DataFrame:
    """(word, cuts) for words over LONGEST: where the symbols of its path end, by the same join; beyond the last each stands alone.

    A word's substrings are handed on one after the other, and its edges gathered under its digest.
    """
    table = words.sparkSession.createDataFrame(_ranks(pieces), "piece string, rank int")

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Pieces(path)
        begin = {p[:k] for p in own.ids for k in range(2, len(p) + 1)}
        out: list[tuple] = []
        for x in batches:
            for word in x["word"]:
                key = md5(word.encode()).hexdigest()
                for i in range(len(word) - 1):
                    for n in range(2, min(own.longest, len(word) - i) + 1):
                        if (piece := word[i : i + n]) not in begin:
                            break
                        out.append((key, i << 6 | n, piece))
                    if len(out) >= SPANS_AT_ONCE:
                        yield pd.DataFrame(out, columns=["key", "at", "piece"])
                        out = []
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "piece"])

    @F.pandas_udf("array<int>")
    def folded(edges: pd.Series) -> pd.Series:
        return pd.Series([fold_long(np.asarray(e)) for e in edges])

    edges = words.select("word").mapInPandas(spans, "key string, at long, piece string").join(F.broadcast(table), "piece")
    grouped = edges.groupBy("key").agg(F.sort_array(F.collect_list(F.col("rank").cast("long") * (1 << 38) + F.col("at"))).alias("edges"))
    return words.select("word", F.md5("word").alias("key")).join(grouped, "key").select("word", folded("edges").alias("cuts"))


def paths(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, n, mask) for words (word, n) dealt by word: bits where the symbols of its path begin and end; words without an edge are left out.

    An edge travels as one number: its piece's rank by score (equal scores share one), its start
    and its length. The edges of a word are gathered where the word is, without another shuffle.
    """
    spark = words.sparkSession
    table = spark.createDataFrame(_ranks(pieces), "piece string, rank int")
    # A substring is made only where a piece begins with its first three, and then four characters.
    begin = {k: ", ".join(_quoted(x) for x in sorted({p[:k] for p, _, _ in pieces.rows if len(p) >= k})) for k in (3, 4)}
    longest = " ".join(["case", *[f"when substring(word, i + 1, {k}) not in ({begin[k]}) then {k - 1}" for k in begin if begin[k]], f"else {pieces.longest} end"])
    starts = words.where(F.length("word") > 1).select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 2)).alias("i"))
    spans = starts.select("word", "n", "i", F.explode(F.expr(f"sequence(2, least(length(word) - i, {longest}))")).alias("size"))
    edges = spans.select("word", "n", (F.col("i") * 64 + F.col("size")).alias("at"), F.substring("word", F.col("i") + 1, F.col("size")).alias("piece"))
    # The vocabulary is bounded, so its table is broadcast.
    hit = edges.join(F.broadcast(table), "piece").select("word", "n", (F.col("rank").cast("long") * 4096 + F.col("at")).alias("edge"))
    grouped = hit.groupBy("word").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("edge")).alias("edges"))
    # The bits of an edge's ends, and those inside it, are looked up by its start and length.
    spans = [(min(i >> 6, LONGEST), min((i >> 6) + (i & 63), LONGEST)) for i in range(4096)]
    constant = lambda bits: F.expr(f"array({', '.join(f'{x}L' for x in bits)})")
    both, within = constant(1 << a | 1 << b for a, b in spans), constant(max(0, (1 << b) - (2 << a)) for a, b in spans)

    def ends(edge):
        at = edge.bitwiseAND(4095).cast("int")
        return F.struct(F.get(both, at).alias("ends"), F.get(within, at).alias("inside"))

    def merge(path, _):
        """Drop the edges one of whose ends is no boundary any more, then merge the first edge with one boundary inside."""

        def first(alive):
            inside = F.get(F.filter(alive, lambda e: F.bit_count(path["mask"].bitwiseAND(e["inside"])) == 1), F.lit(0))["inside"]
            return F.struct(path["mask"].bitwiseAND(F.bitwise_not(F.coalesce(inside, F.lit(0).cast("long")))).alias("mask"), alive.alias("edges"))

        alive = F.filter(path["edges"], lambda e: path["mask"].bitwiseAND(e["ends"]) == e["ends"])
        return F.get(F.transform(F.array(alive), first), F.lit(0))

    every = F.call_function("shiftleft", F.lit(1).cast("long"), F.length("word") + 1) - 1
    begun = F.struct(every.alias("mask"), F.transform("edges", ends).alias("edges"))
    return grouped.select("word", "n", F.aggregate(F.sequence(F.lit(1), F.length("word") - 1), begun, merge)["mask"].alias("mask"))


def _split() -> F.Column:
    """Tells the splits of the input apart, the same in every scan of it."""
    return F.xxhash64(F.input_file_name(), F.expr("input_file_block_start()"))


def _plain_scan(docs: DataFrame) -> bool:
    """Whether rows come straight from one scan of files, so that each knows its split: nothing but columns and filters above it."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation" and bool(docs.inputFiles())


def _encoded(docs: DataFrame, path: str, shown, schema: str) -> DataFrame:
    """The doc_id of every row with the columns that ``shown`` makes of the ids of some texts."""
    spark: SparkSession = docs.sparkSession
    if not _plain_scan(docs):
        docs = written(docs, "piece-docs")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), _split().alias("g"))
    folders = partitions(spark)
    pieces = Pieces(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, seen = Pieces(path), None, set()

        def out() -> pa.RecordBatch:
            words = pa.array({w for chunk in seen for w in own.words(chunk)}, pa.string())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), now, dtype=np.int64)), words], names=["g", "word"])

        for x in batches:
            for g, text in zip(x.column("g").to_pylist(), x.column("text").to_pylist(), strict=True):
                if seen and (g != now or len(seen) > COUNTED_AT_ONCE):
                    yield out()
                    seen = set()
                now = g
                seen.update(own.chunks(text))
        if seen:
            yield out()

    found = written(source.select("g", "text").mapInArrow(count, "g long, word string"), "split-words")
    # So few words for each partition that their edges are gathered in memory, by hash.
    parts = max(partitions(spark), -(-found.count() // WORDS_IN_PART))
    known = found.repartition(parts, "word").groupBy("word").agg(F.count("*").alias("n"))
    setting = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(2 * WORDS_IN_PART))
    try:
        short = written(paths(known.where(F.length("word") <= LONGEST), pieces), "word-paths")
    finally:
        spark.conf.set(setting, before)
    long = written(long_paths(found.where(F.length("word") > LONGEST).select("word").distinct(), pieces, path), "long-paths")
    masked = short.select("word", "mask", F.lit(None).cast("array<int>").alias("cuts")).unionByName(long.select("word", F.lit(None).cast("long").alias("mask"), "cuts"))
    common = written(short.orderBy(F.desc("n"), "word").limit(COMMON).select("word", "mask"), "common-paths")
    folder = fresh_path(spark, "split-paths")
    rare = found.join(F.broadcast(common.select("word")), "word", "left_anti").join(masked, "word").select("g", F.pmod("g", F.lit(folders)).cast("int").alias("p"), "word", "mask", "cuts")
    # A task finds a split's paths in one folder of a few by its row groups. A word that a split has twice is there twice.
    rare.repartition(folders, "p").sortWithinPartitions("p", "g").write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).partitionBy("p").parquet(folder)
    forget(spark, found, short, long)
    files = sorted({f.rsplit("/", 1)[0] for f in common.inputFiles()})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        own = Pieces(path)

        def load(place: str, split: int | None = None) -> dict[str, bytes]:
            store, inner = filesystem(place)
            listed = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
            out: dict = {}
            for f in listed:
                if f.path.endswith(".parquet"):
                    with store.open_input_file(f.path) as opened:
                        t = pq.read_table(opened, columns=["word", "mask"] if split is None else ["word", "mask", "cuts"], filters=None if split is None else [("g", "==", split)])
                        short = t.filter(t["mask"].is_valid())
                        words = short["word"].to_pylist()
                        out.update(zip(words, own.spell(words, short["mask"].to_numpy()), strict=True))
                        if len(short) < len(t):
                            long = t.filter(t["mask"].is_null())
                            out.update((w, own.symbols(w, [*c, *range((c[-1] if c else 0) + 1, len(w) + 1)])) for w, c in zip(long["word"].to_pylist(), long["cuts"].to_pylist(), strict=True))
            return out

        def ids_of(word: str) -> bytes:
            """Without an edge each symbol stands alone."""
            return here.get(word) or everywhere.get(word) or own.symbols(word, [*range(1, len(word) + 1)])

        class Known(dict):
            """Ids of chunks met, made from their words' ids at the first time."""

            def __missing__(self, chunk: str) -> bytes:
                if len(self) > REMEMBERED:
                    self.clear()
                words = own.words(chunk)
                done = self[chunk] = ids_of(words[0]) if len(words) == 1 else b"".join(map(ids_of, words))
                return done

        everywhere: dict[str, bytes] = {}
        for place in files:
            everywhere.update(load(place))
        now, here, known = None, {}, Known()

        for x in batches:
            encoded = []
            for text, g in zip(x.column("text").to_pylist(), x.column("g").to_pylist(), strict=True):
                if g != now:
                    now, here = g, load(f"{folder}/p={g % folders}", g)
                    known.clear()
                encoded.append(np.frombuffer(b"".join(map(known.__getitem__, own.chunks(text))), dtype="<u4"))
            columns = [x.column("doc_id"), *shown(encoded, own)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return source.select("doc_id", "text", "g").mapInArrow(encode, schema)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every (doc_id, text) row, as the library encodes the text; null and empty texts have no ids.

    The documents themselves are not shuffled: their words are, once for each input split that
    has them, and each split reads back the paths of its own words. Documents that aren't a plain
    scan of files, but joined, shuffled or made, are written down first. Repeated rows keep their rows; an empty table gives none.
    """
    return _encoded(docs, path, lambda encoded, _: [pa.array([ids.astype(np.int32) for ids in encoded], pa.list_(pa.int32()))], "doc_id long, ids array<int>")


def decode(encoded: list[np.ndarray], pieces: Pieces) -> list[str]:
    """The texts of lists of ids: their pieces with blanks, bytes put together, without the blank that encoding put before a text."""
    if not any(map(len, encoded)):
        return [""] * len(encoded)
    taken = pieces.strings.take(pa.array(np.concatenate(encoded)))
    ends = np.cumsum([0, *map(len, encoded)])
    at, raw = np.frombuffer(taken.buffers()[1], dtype="<i4")[ends].tolist(), memoryview(taken.buffers()[2])
    return [str(raw[a:b], "utf-8", "replace")[1:] for a, b in zip(at[:-1], at[1:], strict=True)]


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256) of every row: the ids' number and checksum, and the text decoded from them."""

    def shown(encoded: list[np.ndarray], pieces: Pieces) -> list[pa.Array]:
        shas = [sha256(text.encode()).hexdigest() for text in decode(encoded, pieces)]
        return [pa.array([len(ids) for ids in encoded], pa.int64()), pa.array([zlib.crc32(ids.tobytes()) for ids in encoded], pa.int64()), pa.array(shas, pa.string())]

    return _encoded(docs, path, shown, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string")
