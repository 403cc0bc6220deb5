"""Search over nodes and their representations, by words and by vectors, within one scope."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import under
from quillspan.operators import querying, search
from quillspan.operators.nodes import parents, pool_of


def allowed(nodes: DataFrame, client_id, versions: DataFrame | None = None, doc_id=None, scope_path: str | None = None) -> DataFrame:
    """(id) of a tenant's nodes that may be found: not deleted, of a document, at or below a path, of a current version.

    nodes: id, client_id, doc_id, version_id, path, deleted_at. ``versions`` (client_id,
    version_id, is_current) is left out to find old versions too.
    """
    out = nodes.where((F.col("client_id") == client_id) & F.col("deleted_at").isNull())
    out = out if doc_id is None else out.where(F.col("doc_id") == doc_id)
    out = out if scope_path is None else out.where(under(F.col("path"), scope_path))
    if versions is not None:
        keys = ["client_id", "version_id"]
        out = out.join(versions.where("is_current").select(*keys), keys, "left_semi")
    return out.select("id")


def search_all(
    nodes: DataFrame, representations: DataFrame, queries: DataFrame, keep: Callable[[DataFrame], DataFrame], scope: DataFrame, top: int = 20, near: Callable[..., DataFrame] = search.vector
) -> DataFrame:
    """(query_id, id, rnk, score): the best ``top`` nodes of each query, by the reciprocal ranks of up to four legs.

    The legs are the words and the vectors of nodes (id, text, embedding) and of representations
    (id, node_id, text, embedding), each within ``scope`` (id) and as long as ``pool_of(top)``; a
    node counts once for each of its representations in a leg. queries: query_id, query_text and
    embedding; without the last column there are no vector legs, and a null one finds nothing by
    vector. ``near`` is the exact vector search, or an approximate one with its arguments.
    """
    pool = pool_of(top)
    inside = keep(scope.select("id").distinct())
    held = representations.join(inside.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    words = queries.select("query_id", "query_text")
    legs = [querying.search(nodes.select("id", "text"), words, keep, pool, inside), parents(querying.search(held.select("id", "text"), words, keep, pool), held)]
    if "embedding" in queries.columns:
        asked = queries.select("query_id", "embedding").where("embedding is not null")
        legs += [near(nodes.select("id", "embedding"), asked, pool=pool, scope=inside), parents(near(held.select("id", "embedding"), asked, pool=pool), held)]
    return search.fuse(legs, top)
