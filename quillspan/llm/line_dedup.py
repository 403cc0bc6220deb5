"""Line dedup: an exact set-similarity join of lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import forget, written
from quillspan.llm.ordered import numbered

#: Shingle buckets counted for rarity (a power of two, so many that the first aggregate keeps them in
#: its fast map), and the commonest of them that the order knows. Any order gives the same matches.
COUNTED_BUCKETS, COMMON = 1 << 16, 4096
#: Index lists longer than this are first compared with their leaders, of which each has so many.
LED, LEADERS = 16, 8
#: Entries of an index list that one task joins; longer lists are salted.
IN_ONE_LIST = 4096
#: Candidates of a line that are verified first, the closest ones; the rest only if none of them matches.
CLOSEST = 4
NULL_KEY = -(2**63)
_SPACES = " \t\n\x0b\x0c\r"
#: A line's place: the key of its doc_id, the number of its row among rows of that doc_id, its number in the text.
_PLACE = ["doc", "row", "line_no"]
_X, _Y = ([f"{c}_{side}" for c in _PLACE] for side in "xy")
_PAIR = [*_X, *_Y]
#: Places of lines, and repeated doc_ids, that may be broadcast to keep texts from being shuffled; beyond it all are.
BROADCAST_ROWS = 1_000_000


def _bare(line: Column) -> Column:
    """A line in lower case without white space at its ends; most lines have none and aren't searched for it."""
    ends = F.lit(False)
    for c in _SPACES:
        ends = ends | F.startswith(line, F.lit(c)) | F.endswith(line, F.lit(c))
    return F.lower(F.when(ends, F.trim(line, F.lit(_SPACES))).otherwise(line))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(bare: Column) -> Column:
    """The words between white space; the usual line, with single blanks only, needs no pattern."""
    odd = F.lit(False)
    for gap in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains(bare, F.lit(gap))
    return F.when(odd, F.split(bare, r"[\x20\x09-\x0D]+", -1)).otherwise(F.split(bare, " ", -1))


def _shingles(words: Column, size: int, digest) -> Column:
    """Distinct digests of the shingles of so many words, made of the words' own; fewer words are one shingle."""
    many = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: digest(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, F.array_distinct(many)).otherwise(F.array(digest(words)))


def _word_digests(bare: Column) -> Column:
    return F.transform(_words(bare), lambda w: F.xxhash64(w))


def _tokens(bare: Column, size: int) -> Column:
    """(n, tokens, sketch) of a line: the size of its set, 32 bits of each shingle, and the parity of the tokens in 64 classes.

    ``n`` counts 64-bit digests, so shingles of one line that share a token are still counted apart.
    """

    def of(words: Column) -> Column:
        places = F.greatest(F.size(words) - size + 1, F.lit(1))
        exact = lambda t: F.when(F.size(t) == places, places).otherwise(F.size(_shingles(words, size, F.xxhash64)))
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        parity = lambda t: F.aggregate(t, none, lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", one, x)))
        return _once(_shingles(words, size, F.hash), lambda t: F.struct(exact(t).alias("n"), t.alias("tokens"), parity(t).alias("sketch")))

    return _once(_word_digests(bare), of)


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with _doc and _row, which name a text: rows share both only if doc_id and text are equal.

    ``_row`` is 0 for a doc_id of one row. Different texts of one doc_id, or of the null one, get
    different numbers in the order of their SHA-256. Only rows of repeated doc_ids are written anew.
    """
    keyed = docs.withColumn("_doc", _key())
    repeated = written(keyed.groupBy("_doc").count().where("count > 1").select("_doc"), "repeated-ids")
    n = repeated.count()
    if not n:
        return keyed.withColumn("_row", F.lit(0).cast("long"))
    few = F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated
    some = keyed.join(few, "_doc", "left_semi").withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    numbers = numbered(some.select("_doc", "_sha").distinct(), [F.col("_doc"), F.col("_sha")], "_row")
    some = written(some.join(numbers, ["_doc", "_sha"]).drop("_sha"), "repeated-rows")
    return keyed.join(few, "_doc", "left_anti").withColumn("_row", F.lit(0).cast("long")).unionByName(some)


def _lines(docs: DataFrame, size: int) -> DataFrame:
    """(doc, row, line_no, s1, s2, n, tokens, sketch) of every line that has a word; s1 and s2 are 128 bits of its bare text."""
    parts = docs.select(F.col("_doc").alias("doc"), F.col("_row").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    some = parts.where(F.ltrim("line", F.lit(_SPACES)) != "")
    row = _once(_bare(F.col("line")), lambda b: F.struct(F.xxhash64(b).alias("s1"), F.xxhash64(F.lit(1), b).alias("s2"), _tokens(b, size).alias("t")))
    return written(some.select(*_PLACE, row.alias("r")).select(*_PLACE, "r.s1", "r.s2", "r.t.n", "r.t.tokens", "r.t.sketch"), "lines", dictionary=False)


def _prefix_length(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / 100).cast("int") + 1


def _sizes_fit(x: str, y: str, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _far(x: str, y: str) -> Column:
    """Classes that one of two sketches has odd and the other even: no more than the elements in which the sets differ."""
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y)))


def _near_enough(far: Column, n_x: str, n_y: str, percent: int) -> Column:
    return (100 + percent) * far <= (100 - percent) * (F.col(n_x) + F.col(n_y))


def _first_lines(lines: DataFrame, percent: int) -> DataFrame:
    """(s1, s2, doc, row, line_no, n, sketch, lead, lines): of equal lines the earliest, its leading tokens, and how many there are."""
    # Rarity: buckets of tokens by how often they occur in all lines.
    buckets = lines.select(F.explode("tokens").alias("t")).groupBy(F.col("t").bitwiseAND(COUNTED_BUCKETS - 1).alias("bucket")).count()
    counted = written(buckets, "token-buckets")
    mean = counted.agg(F.avg("count")).first()[0] or 0
    # Buckets that hold more than chance puts into one.
    top = [r["bucket"] for r in counted.where(F.col("count") > mean + 6 * mean**0.5 + 8).orderBy(F.desc("count"), "bucket").limit(COMMON).collect()]
    common = f"t & {COUNTED_BUCKETS - 1} in ({', '.join(map(str, top))})" if top else "false"
    # Elements that can't be null are sorted as numbers.
    ranked = F.expr(f"transform(tokens, t -> coalesce(if({common}, {1 << 32}, 0L) + (cast(t as bigint) & {(1 << 32) - 1}L), 0L))")
    lead = F.slice(F.sort_array(ranked), F.lit(1), _prefix_length(F.col("n"), percent))
    leads = lines.select("s1", "s2", F.struct(*_PLACE, "n", "sketch", lead.alias("lead")).alias("line"))
    # The aggregate combines before the shuffle, however common a line is.
    firsts = written(leads.groupBy("s1", "s2").agg(F.min("line").alias("line"), F.count("*").alias("lines")).select("s1", "s2", "line.*", "lines"), "first-lines")
    forget(lines.sparkSession, counted)
    return firsts


def _index(firsts: DataFrame) -> DataFrame:
    """(t, m, doc, row, line_no, n, i, before, sketch): entries of the lists of m > 1 leading tokens t, the place and the token before it.

    Numbers travel packed in pairs. Lists of one entry, which are most, end at this shuffle.
    """
    low = (1 << 32) - 1
    steps = firsts.select(*_PLACE, "n", "sketch", "lead", F.posexplode("lead").alias("i", "t"))
    before = F.when(F.col("i") > 0, F.get("lead", F.col("i") - 1)).otherwise(0).bitwiseAND(low)
    packed = steps.select("t", "doc", "row", (F.col("line_no").cast("long") * (1 << 32) + before).alias("p"), (F.col("n").cast("long") * (1 << 32) + F.col("i")).alias("q"), "sketch")
    lists = packed.withColumn("m", F.count("*").over(Window.partitionBy("t"))).where("m > 1")
    high = lambda c: F.shiftright(c, 32).cast("int")
    part = lambda c: F.col(c).bitwiseAND(low)
    return written(lists.select("t", "m", "doc", "row", high("p").alias("line_no"), high("q").alias("n"), part("q").cast("int").alias("i"), part("p").alias("before"), "sketch"), "line-lists")


def _led(lists: DataFrame, percent: int) -> DataFrame:
    """Each line of a long list with the earlier leader that seems closest; a list has LEADERS of them, the earliest of each share."""
    long = lists.where(F.col("m") > LED)
    share = F.pmod(F.xxhash64(*_PLACE), F.lit(LEADERS))
    leaders = long.groupBy("t", share.alias("share")).agg(F.min(F.struct(*_PLACE, "n", "sketch")).alias("l"))
    leaders = leaders.groupBy("t").agg(F.collect_list("l").alias("leaders"))
    met = long.select("t", *_PLACE, "n", "sketch").join(leaders, "t").select(*_PLACE, "n", "sketch", F.explode("leaders").alias("l"))
    met = met.select(*[F.col(f"l.{c}").alias(f"{c}_x") for c in _PLACE], *[F.col(c).alias(f"{c}_y") for c in _PLACE], F.col("n").alias("n_y"), F.col("l.n").alias("n_x"), _far("sketch", "l.sketch").alias("far"))
    near = met.where((F.struct(*_X) < F.struct(*_Y)) & _sizes_fit("n_x", "n_y", percent) & _near_enough(F.col("far"), "n_x", "n_y", percent))
    best = near.groupBy(*_Y).agg(F.min(F.struct("far", *_X)).alias("l"))
    return written(best.select(*[f"l.{c}" for c in _X], *_Y), "leader-pairs")


def _candidates(lists: DataFrame, open_lines: DataFrame, percent: int) -> DataFrame:
    """Earlier lines that share a leading token with an open one and may be similar enough: (pair, far, nth).

    A pair is skipped if the lengths are too far apart, if what is left behind the two places
    can't reach the overlap, if the tokens just before are equal, as the pair then meets there
    too, or if the sketches differ too much. Long lists are dealt over salts. ``nth`` numbers an
    open line's candidates, the closest first.
    """
    fan = F.ceil(F.col("m") / IN_ONE_LIST).cast("int")
    side = lambda rows, salt, c: rows.select("t", salt.alias("salt"), *[F.col(x).alias(f"{x}_{c}") for x in (*_PLACE, "n", "i", "before", "sketch")])
    x = side(lists, F.pmod(F.xxhash64(*_PLACE), fan).cast("int"), "x")
    y = side(lists.join(open_lines, _PLACE, "left_semi"), F.explode(F.sequence(F.lit(0), fan - 1)), "y")
    reach = F.least(F.col("n_x") - F.col("i_x"), F.col("n_y") - F.col("i_y"))
    far = _far("sketch_x", "sketch_y")
    close = (
        (F.struct(*_X) < F.struct(*_Y))
        & _sizes_fit("n_x", "n_y", percent)
        & ((100 + percent) * reach >= percent * (F.col("n_x") + F.col("n_y")))
        & ~((F.col("i_x") > 0) & (F.col("i_y") > 0) & (F.col("before_x") == F.col("before_y")))
        & _near_enough(far, "n_x", "n_y", percent)
    )
    pairs = x.join(y, [x["t"] == y["t"], x["salt"] == y["salt"], close]).select(*_PAIR, far.alias("far")).distinct()
    nth = F.row_number().over(Window.partitionBy(*_Y).orderBy("far", *_X))
    return written(pairs.withColumn("nth", nth), "line-pairs")


def _ends(pairs: DataFrame) -> DataFrame:
    x, y = (pairs.select(*[F.col(f"{c}_{side}").alias(c) for c in _PLACE]) for side in "xy")
    return written(x.unionByName(y).distinct(), "line-ends")


def _by_text(places: DataFrame, numbers: Column) -> DataFrame:
    """(doc, row, numbers): the places of a written table by text, to be broadcast if they are few."""
    grouped = places.groupBy("doc", "row").agg(numbers)
    return F.broadcast(grouped) if places.count() <= BROADCAST_ROWS else grouped


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets (doc, row, line_no, s) are similar enough."""
    side = lambda c: sets.select(*[F.col(x).alias(f"{x}_{c}") for x in (*_PLACE, "s")])
    both = pairs.select(*_PAIR).join(side("x"), _X).join(side("y"), _Y)
    shared = F.size(F.array_intersect("s_x", "s_y"))
    return both.where(100 * shared >= percent * (F.size("s_x") + F.size("s_y") - shared)).select(*_PAIR)


def _later(pairs: DataFrame) -> DataFrame:
    return pairs.select(*[F.col(f"{c}_y").alias(c) for c in _PLACE]).distinct()


def _verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The later lines of pairs that hold on 64-bit shingles, made anew from the texts of their lines alone."""
    ends = _ends(pairs)
    by_doc = _by_text(ends, F.array_distinct(F.collect_list("line_no")).alias("numbers"))
    some = docs.select(F.col("_doc").alias("doc"), F.col("_row").alias("row"), "text").join(by_doc, ["doc", "row"])
    lines = some.select("doc", "row", F.explode(_once(F.split("text", "\n", -1), lambda all_: F.transform("numbers", lambda i: F.struct(i.alias("line_no"), F.get(all_, i).alias("line"))))).alias("l"))
    sets = lines.select("doc", "row", "l.line_no", _once(_word_digests(_bare(F.col("l.line"))), lambda w: _shingles(w, size, F.xxhash64)).alias("s"))
    sets = written(sets.dropDuplicates(_PLACE), "line-sets", dictionary=False)
    out = written(_later(_similar(pairs, sets, percent)), "later-lines")
    forget(docs.sparkSession, ends, sets)
    return out


def _matched(docs: DataFrame, lists: DataFrame, open_lines: DataFrame, size: int, percent: int) -> DataFrame:
    """Open lines that an earlier line is similar to."""
    pairs = _candidates(lists, open_lines, percent)
    found = _verified(docs, pairs.where(F.col("nth") <= CLOSEST).select(*_PAIR), size, percent)
    rest = pairs.where(F.col("nth") > CLOSEST).join(found.toDF(*_Y), _Y, "left_anti")
    if rest.limit(1).count():
        found = found.unionByName(_verified(docs, written(rest.select(*_PAIR), "line-pairs"), size, percent))
    return found


def removed_lines(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc, row, line_no) of every line of ``_keyed`` rows that equals an earlier one or whose first copy is similar to an earlier one.

    A line whose first copy goes goes anyway, as its first copy is earlier. Tables of all lines
    go as soon as the index has what it needs of them.
    """
    spark = docs.sparkSession
    lines = _lines(docs, size)
    firsts = _first_lines(lines, percent)
    repeated = firsts.where("lines > 1").select("s1", "s2", F.col("doc").alias("_d"), F.col("row").alias("_r"), F.col("line_no").alias("_l"))
    equal = written(lines.select(*_PLACE, "s1", "s2").join(repeated, ["s1", "s2"]).where("doc <> _d or row <> _r or line_no <> _l").select(*_PLACE), "equal-lines")
    forget(spark, lines)
    lists = _index(firsts)
    forget(spark, firsts)
    # A line that its leader closes on whole sets needs no other pairs.
    led = _led(lists, percent)
    closed = _verified(docs, led, size, percent)
    open_lines = written(lists.select(*_PLACE).distinct().join(closed, _PLACE, "left_anti"), "open-lines")
    later = _matched(docs, lists, open_lines, size, percent)
    forget(spark, led, lists, open_lines)
    return equal.unionByName(closed).unionByName(later)


def dedup_lines(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with later copies and near copies of lines removed; n_lines and n_removed are added.

    Lines end at line feeds and are compared in lower case without white space at their ends.
    A line's set holds its shingles of ``size`` words (of all words, where it has fewer). A line
    goes if an earlier line in ascending (doc_id, line number) has the same text or a set with
    100 * intersection >= percent * union. The text becomes the other lines in their order.

    Lines without words stay and match nothing. Null texts stay null, with no lines. A null doc_id
    sorts first. Different texts of one doc_id, null included, are documents of their own in the
    order of their SHA-256, so a line goes by its own text alone; rows of one doc_id and one text
    are one document, so repeated rows lose the same lines. An empty table gives no rows. Other
    columns pass through, n_lines and n_removed are replaced.

    Equal lines (by 128 bits) are joined once. Tokens are ordered by rarity: the commonest buckets
    of them last, the rest by hash. Leading tokens are indexed; index entries meet on the token
    and are filtered by length, position and sketch; candidates are verified on whole sets of
    64-bit shingles. The index has 32 bits of a shingle, but lengths count 64-bit shingles, so
    two shingles of a line that agree on 32 bits lose no match.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = _keyed(docs.select(*own))
    gone = removed_lines(keyed, size, percent)
    by_doc = _by_text(gone, F.collect_set("line_no").alias("_gone")).withColumnsRenamed({"doc": "_doc", "row": "_row"})
    all_lines = F.split("text", "\n", -1)
    left = _once(all_lines, lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone"), lambda i: F.get(lines, i)))
    joined = keyed.join(by_doc, ["_doc", "_row"], "left")
    n = F.coalesce(F.size(all_lines), F.lit(0))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in own],
        F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull() | F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
    )
