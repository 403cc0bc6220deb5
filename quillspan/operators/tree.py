"""Trees with materialized paths: building, scoping, ordering, chunking and representations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan import ontology
from quillspan.functions.tables import kept
from quillspan.functions.text import base_path, once, path_depth, token_estimate, under


def subtree(nodes: DataFrame, prefix: str | None = None, max_depth: int | None = None) -> DataFrame:
    """Nodes at or below a path, down to a depth."""
    out = nodes if prefix is None else nodes.where(under(F.col("path"), prefix))
    return out if max_depth is None else out.where(F.col("depth") <= max_depth)


def nest(nodes: DataFrame, levels: int | None = None) -> DataFrame:
    """Flat rows in the order of a nested reading: siblings by (seq, path); a node without its parent is a root.

    ``order_key`` joins zero-padded sequence numbers from the root down. Each level is one join
    of children to their parents' keys, written down, until a level is empty or ``levels`` are
    done. Nodes on a cycle have no root and are left out.
    """
    own = F.concat(F.format_string("%08d", "seq"), F.lit("/"), F.col("path"))
    parents = nodes.select(F.col("id").alias("_parent"))
    rooted = kept(nodes.join(parents, nodes["parent_id"] == parents["_parent"], "left").select(nodes["*"], F.col("_parent").isNull().alias("is_root")))
    done = rooted.where("is_root").withColumn("order_key", own).withColumn("level", F.lit(0))
    below, out = rooted.where(~F.col("is_root")), done
    while levels is None or levels > 1:
        above = done.select(F.col("id").alias("_above"), F.col("order_key").alias("_key"), F.col("level").alias("_level"))
        found = below.join(above, below["parent_id"] == above["_above"])
        done = kept(found.select(below["*"], F.concat_ws("|", "_key", own).alias("order_key"), (F.col("_level") + 1).alias("level")))
        if not done.limit(1).count():
            break
        out, levels = out.unionByName(done), None if levels is None else levels - 1
    return out


def sections(lines: DataFrame) -> DataFrame:
    """(doc_id, page, body): lines (doc_id, page, line_no, text) of each page in order, empty ones left out."""
    kept = lines.where(F.trim("text") != "")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return kept.groupBy("doc_id", "page").agg(F.trim(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")).alias("body"))


def text_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): the trimmed non-blank lines of a text."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return each.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.trim("line").alias("line")).where("line <> ''")


def _longest_tail(words: Column, width: int) -> Column:
    """The last words of a text joined by blanks that fit a width, one at least."""
    end = F.right(words, F.lit(width))
    whole = (F.length(words) <= width) | (F.substring(words, F.length(words) - width, F.lit(1)) == " ")
    return F.when(whole, end).when(F.contains(end, F.lit(" ")), F.regexp_replace(end, r"^\S*\s", "")).otherwise(F.substring_index(words, " ", -1))


def chunks(text: Column, max_tokens: int = 512, overlap_tokens: int = 64, sliver: int = 20) -> Column:
    """Chunks of a text by paragraphs (blank lines), as folds over its pieces.

    Paragraphs are packed while the sum of their estimates stays within ``max_tokens``. A longer
    paragraph is cut at words, each part beginning with the last words of the one before, up to
    ``overlap_tokens`` (less than ``max_tokens``). Then every chunk under ``sliver`` tokens joins
    the one before if both fit, and a first one that still stands alone the one behind.
    """
    if max_tokens <= 0:
        raise ValueError("max_tokens must be positive")
    width, tail = max_tokens * 4, max(min(overlap_tokens, max_tokens - 1), 0) * 4
    paragraphs = F.filter(F.transform(F.split(text, r"\n[ \t]*\n+"), lambda p: F.trim(p, F.lit(" \t\r\n"))), lambda p: p != "")
    empty, none = F.array().cast("array<string>"), F.lit("")

    def split_words(paragraph: Column) -> Column:
        def step(acc: Column, word: Column) -> Column:
            fits = (acc["now"] == "") | (F.length(acc["now"]) + 1 + F.length(word) <= width)
            begin = _longest_tail(acc["now"], tail) if tail else none
            joined = lambda left: F.when(left == "", word).otherwise(F.concat_ws(" ", left, word))
            return F.struct(F.when(fits, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["now"]))).alias("out"), F.when(fits, joined(acc["now"])).otherwise(joined(begin)).alias("now"))

        return F.aggregate(F.split(paragraph, r"\s+"), F.struct(empty.alias("out"), none.alias("now")), step, lambda acc: F.concat(acc["out"], F.array(acc["now"])))

    def pack(acc: Column, paragraph: Column) -> Column:
        flushed = F.when(acc["now"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["now"])))
        size = token_estimate(paragraph)
        big, fits = size > max_tokens, (acc["now"] == "") | (acc["tokens"] + size <= max_tokens)
        longer = F.when(acc["now"] == "", paragraph).otherwise(F.concat_ws("\n\n", acc["now"], paragraph))
        return F.struct(
            F.when(big, F.concat(flushed, split_words(paragraph))).when(fits, acc["out"]).otherwise(flushed).alias("out"),
            F.when(big, "").when(fits, longer).otherwise(paragraph).alias("now"),
            F.when(big, 0).when(fits, acc["tokens"] + size).otherwise(size).cast("long").alias("tokens"),
        )

    start = F.struct(empty.alias("out"), none.alias("now"), F.lit(0).cast("long").alias("tokens"))
    packed = F.aggregate(paragraphs, start, pack, lambda acc: F.when(acc["now"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["now"]))))
    small = lambda one, other: (token_estimate(one) < sliver) & (token_estimate(one) + token_estimate(other) <= max_tokens)

    def back(acc: Column, chunk: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        merged = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws("\n\n", last, chunk)))
        return F.when((F.size(acc) > 0) & small(chunk, last), merged).otherwise(F.concat(acc, F.array(chunk)))

    def forward(all_: Column) -> Column:
        first, second = F.get(all_, F.lit(0)), F.get(all_, F.lit(1))
        merged = F.concat(F.array(F.concat_ws("\n\n", first, second)), F.slice(all_, F.lit(3), F.greatest(F.size(all_) - 2, F.lit(0))))
        return F.when((F.size(all_) > 1) & small(first, second), merged).otherwise(all_)

    return once(F.aggregate(packed, empty, back), forward)


def build(docs: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Nodes (path, node_type, seq, depth, content, sensitivity, doc_id) of (doc_id, client_id, doc_type, sensitivity, text).

    A root, one section, its chunks, and a section of facts where there are any, which stays LOW.
    """
    base = docs.withColumn("base", base_path(F.col("client_id"), F.col("doc_type"), F.lit(1)))
    made = base.withColumn("base", F.concat_ws(".", "base", F.concat(F.lit("d"), F.col("doc_id").cast("string"))))
    node = lambda df, path, kind, seq, content, level=F.col("sensitivity"): df.select("doc_id", path.alias("path"), F.lit(kind).alias("node_type"), seq.cast("long").alias("seq"), content.alias("content"), level.alias("sensitivity"))
    none = F.lit(None).cast("string")
    out = node(made, F.col("base"), "document", F.lit(0), none)
    out = out.unionByName(node(made, F.concat("base", F.lit(".s0")), "section", F.lit(0), none))
    parts = made.select("doc_id", "base", "sensitivity", F.posexplode(chunks(F.col("text"))).alias("at", "chunk"))
    out = out.unionByName(node(parts, F.concat("base", F.lit(".s0.c"), F.col("at").cast("string")), "chunk", F.col("at"), F.col("chunk")))
    if facts is not None:
        has = made.join(facts.select("doc_id").distinct(), "doc_id", "left_semi")
        out = out.unionByName(node(has, F.concat("base", F.lit(".facts")), "section", F.lit(1), none, F.lit("LOW")))
    return out.withColumn("depth", path_depth(F.col("path")))


def build_pages(docs: DataFrame, lines: DataFrame, facts: DataFrame) -> DataFrame:
    """The whole tree of each document: (doc_id, path, node_type, seq, depth, title, content, attribute_key, value_text, sensitivity).

    docs: doc_id, client_id, doc_type, sensitivity, text. A root; a section for each page of its
    lines (doc_id, page, line_no, text) that has text, or one for the body of a document
    without lines; their chunks; and behind them a section of its facts (doc_id, fact_no,
    attribute_key, value_text, sensitivity), if it has any. Facts keep their own sensitivity, the
    section above them is LOW, all other nodes have the document's. Null and blank texts are no sections.
    """
    base = base_path(F.col("client_id"), F.col("doc_type"), F.lit(1))
    made = docs.select("doc_id", F.concat_ws(".", base, F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("base"), "doc_type", "sensitivity", F.trim("text", F.lit(" \t\r\n")).alias("body"))
    none = F.lit(None).cast("string")

    def node(rows: DataFrame, path: Column, kind: str, seq: Column, title=none, content=none, key=none, value=none, level=F.col("sensitivity")) -> DataFrame:
        return rows.select("doc_id", path.alias("path"), F.lit(kind).alias("node_type"), seq.cast("long").alias("seq"), path_depth(path).alias("depth"), title.alias("title"), content.alias("content"), key.alias("attribute_key"), value.alias("value_text"), level.alias("sensitivity"))

    by = Window.partitionBy("doc_id")
    paged = sections(lines).where("body <> ''").withColumn("at", F.row_number().over(by.orderBy("page")) - 1).withColumn("title", F.concat(F.lit("page "), F.col("page").cast("string")))
    alone = made.join(lines.select("doc_id").distinct(), "doc_id", "left_anti").where("body <> ''").select("doc_id", F.lit("body").alias("title"), F.lit(0).alias("at"), "body")
    # Written, as sections are read for themselves, their chunks and their number.
    bodies = kept(paged.select("doc_id", "title", "at", "body").unionByName(alone))
    placed = bodies.join(made.drop("body"), "doc_id").withColumn("own", F.concat("base", F.lit(".s"), F.col("at").cast("string")))
    parts = placed.select("doc_id", "own", "sensitivity", F.posexplode(chunks(F.col("body"))).alias("k", "chunk"))
    told = facts.join(bodies.groupBy("doc_id").agg(F.count("*").alias("at")), "doc_id", "left").join(made.select("doc_id", "base"), "doc_id")
    told = told.withColumn("own", F.concat("base", F.lit(".s"), F.coalesce("at", F.lit(0)).cast("string"))).withColumn("k", F.row_number().over(by.orderBy("fact_no")) - 1)
    below = lambda letter: F.concat("own", F.lit("." + letter), F.col("k").cast("string"))
    out = node(made, F.col("base"), "document", F.lit(0), F.col("doc_type"))
    out = out.unionByName(node(placed, F.col("own"), "section", F.col("at"), F.col("title"), F.col("body")))
    out = out.unionByName(node(parts, below("c"), "chunk", F.col("k"), content=F.col("chunk")))
    out = out.unionByName(node(told.where("k = 0"), F.col("own"), "section", F.coalesce("at", F.lit(0)), F.lit("facts"), level=F.lit("LOW")))
    return out.unionByName(node(told, below("f"), "fact", F.col("k"), F.col("attribute_key"), key=F.col("attribute_key"), value=F.col("value_text")))


def representations(nodes: DataFrame) -> DataFrame:
    """(path, rep_type, rep_text) for content nodes with text, by the deterministic stub of the model."""
    content = nodes.where(F.col("content").isNotNull() & (F.trim("content") != ""))
    return content.select("path", F.explode(F.array(*[F.lit(r) for r in ontology.REPRESENTATIONS])).alias("rep_type"), "content").select("path", "rep_type", F.concat(F.lit("[stub:"), F.col("rep_type"), F.lit("] "), F.substring("content", 1, 120)).alias("rep_text"))
