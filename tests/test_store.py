"""Verdicts as they are recorded, whole trees, deletes, provenance and search in four legs, on small awkward tables."""

from pyspark.sql import functions as F

from quillspan.functions.tables import kept
from quillspan.operators import hybrid, merge, service, serving, tree, versions

VERDICT = "client_id int, attribute_key string, instance_key string, verdict string, override_text string"
LIVE, ASKED = f"{VERDICT}, created_at int, updated_at int", f"client_id int, attribute_key string, instance_key string, no int, verdict string, override_text string, at int"


def test_record_verdicts(spark):
    live = spark.createDataFrame([(1, "a", "", "accept", None, 5, 6), (1, "b", "", "reject", None, 5, 5), (2, "a", "", "accept", None, 5, 5)], LIVE)
    asked = spark.createDataFrame(
        [
            (1, "a", "", 1, "reject", None, 10), (1, "a", "", 2, "override", "x", 11),
            (1, "b", "", 1, "cleared", None, 10), (1, "b", "", 2, "cleared", None, 11), (1, "b", "", 3, "accept", None, 12),
            (3, "c", "", 1, "cleared", None, 10), (3, "d", "i", 1, "accept", None, 10), (3, "d", "i", 2, "cleared", None, 11),
        ],
        ASKED,
    )
    after, events = merge.record_verdicts(live, asked)
    assert sorted(map(tuple, after.collect())) == [(1, "a", "", "override", "x", 5, 11), (1, "b", "", "accept", None, 12, 12), (2, "a", "", "accept", None, 5, 5)]
    assert sorted((r.client_id, r.attribute_key, r.no) for r in events.collect()) == [(1, "a", 1), (1, "a", 2), (1, "b", 1), (1, "b", 3), (3, "d", 1), (3, "d", 2)]
    empty, none = merge.record_verdicts(live.limit(0), asked.limit(0))
    assert empty.count() == none.count() == 0


def test_build_pages(spark):
    docs = spark.createDataFrame([(1, "c", "T", "HIGH", None), (2, "c", "T", "LOW", " body "), (3, "c", "T", "LOW", "unused"), (4, "c", "T", "LOW", " ")], "doc_id int, client_id string, doc_type string, sensitivity string, text string")
    lines = spark.createDataFrame([(3, 2, 1, "b"), (3, 1, 2, "a2"), (3, 1, 1, "a1"), (3, 9, 1, " "), (3, 10, 1, None)], "doc_id int, page int, line_no int, text string")
    facts = spark.createDataFrame([(3, 7, "k", "v", "CRITICAL"), (3, 3, "j", None, "LOW"), (4, 1, "k", "v", "LOW")], "doc_id int, fact_no int, attribute_key string, value_text string, sensitivity string")
    rows = tree.build_pages(docs, lines, facts).collect()
    shown = {n: sorted((r.path.split(f".d{n}")[1], r.node_type, r.seq, r.title, r.content, r.sensitivity) for r in rows if r.doc_id == n) for n in range(1, 5)}
    assert shown[1] == [("", "document", 0, "T", None, "HIGH")]
    assert shown[2] == [("", "document", 0, "T", None, "LOW"), (".s0", "section", 0, "body", "body", "LOW"), (".s0.c0", "chunk", 0, None, "body", "LOW")]
    assert [x[:4] for x in shown[3]] == [("", "document", 0, "T"), (".s0", "section", 0, "page 1"), (".s0.c0", "chunk", 0, None), (".s1", "section", 1, "page 2"), (".s1.c0", "chunk", 0, None), (".s2", "section", 2, "facts"), (".s2.f0", "fact", 0, "j"), (".s2.f1", "fact", 1, "k")]
    assert shown[3][1][4] == "a1\na2" and [x[5] for x in shown[3][5:]] == ["LOW", "LOW", "CRITICAL"]
    assert [x[0] for x in shown[4]] == ["", ".s0", ".s0.f0"]
    assert all(r.depth == r.path.count(".") + 1 for r in rows)


def test_provenance_of_another_tenant(spark):
    nodes = spark.createDataFrame([(1, "a", 7, 1, "fact", "k", None, 0.5, "p")], "id int, client_id string, doc_id int, version_id int, node_type string, attribute_key string, verification_status string, confidence double, provenance string")
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, None)], "node_id int, client_id string")
    got = sorted((str(r.node_id), str(r.client_id), r.doc_id, r.problem) for r in serving.provenance(nodes, asked).collect())
    assert got == [("1", "a", 7, None), ("1", "b", None, "not found"), ("2", "a", None, "not found"), ("None", "None", None, "not found")]


def test_purge_leaves_other_tables(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "client_id string")
    tables = {name: df for name in [*service.TENANT_TABLES, "access_log"]}
    left, counts = service.purge(tables, df.where("client_id = 'a'"))
    assert left["access_log"].count() == 3 and all(left[n].count() == 2 for n in service.TENANT_TABLES)
    assert {(r.removed, r.kept) for r in counts.collect()} == {(1, 2)}


def test_diff_takes_the_last_of_a_path(spark):
    old = spark.createDataFrame([("p", "x", 1), ("p", "y", 2), ("q", "x", 1)], "path string, hash string, seq int")
    new = spark.createDataFrame([("p", "y", 1), ("r", "z", 1)], "path string, hash string, seq int")
    assert sorted(map(tuple, versions.diff(old, new).collect())) == [("q", "removed"), ("r", "added")]


def test_four_legs(spark):
    row = lambda i, text, v, client="t", version=1, path="a.b", gone=None: (i, text, v, client, 1, version, path, gone)
    nodes = spark.createDataFrame(
        [row(1, "red fox", [1.0, 0.0]), row(2, "blue", [0.0, 1.0]), row(3, "red fox", [1.0, 0.0], client="u"), row(4, "red fox", [1.0, 0.0], version=2), row(5, "red fox", [1.0, 0.0], path="a.bc"), row(6, "red fox", [1.0, 0.0], gone="x"), row(7, None, None)],
        "id int, text string, embedding array<double>, client_id string, doc_id int, version_id int, path string, deleted_at string",
    )
    current = spark.createDataFrame([("t", 1, True), ("t", 2, False), ("u", 1, True)], "client_id string, version_id int, is_current boolean")
    reps = spark.createDataFrame([(10, 2, "red fox", None), (11, 2, "fox red", [1.0, 0.0]), (12, 4, "red", [1.0, 0.0])], "id int, node_id int, text string, embedding array<double>")
    asked = spark.createDataFrame([(1, "red fox", [1.0, 0.0]), (2, "none", None)], "query_id int, query_text string, embedding array<double>")
    scope = hybrid.allowed(nodes, "t", current, scope_path="a.b")
    assert sorted(r.id for r in scope.collect()) == [1, 2, 7]
    got = {(r.query_id, r.id): r.score for r in hybrid.search_all(nodes, reps, asked, kept, scope, top=5).collect()}
    # The second node is found by two representations' words, by its own vector behind the first, and by one representation's vector.
    assert got == {(1, 1): round(2 / 61, 9), (1, 2): round(1 / 61 + 1 / 62 + 1 / 62 + 1 / 61, 9)}
    words = hybrid.search_all(nodes, reps, asked.drop("embedding"), kept, scope, top=5)
    assert {(r.query_id, r.id): r.score for r in words.collect()} == {(1, 1): round(1 / 61, 9), (1, 2): round(1 / 61 + 1 / 62, 9)}
    assert hybrid.allowed(nodes, "t", scope_path="a").where(F.col("id") == 4).count() == 1
