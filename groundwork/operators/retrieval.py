"""Document chunking and the context handed to an answer generator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions.vectors import DOT
from groundwork.operators.vectors import MAX_BROADCAST_ROWS, topk_batch_sized, vector_topk
from groundwork.sources.scratch import checkpointed


def chunk_documents(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(key, chunk_no, chunk): windows of ``size`` characters, ``overlap`` shared with the next.

    Together the windows cover the whole text; the last one is not repeated inside another.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    last = F.greatest(F.length(text) - overlap - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(step))
    return (
        df.where(F.length(text) > 0)
        .select(key, text, F.posexplode(starts).alias("chunk_no", "start"))
        .select(key, "chunk_no", F.substring(F.col(text), F.col("start") + 1, F.lit(size)).alias("chunk"))
    )


def search_chunks(
    corpus: DataFrame, contents: DataFrame, query: Sequence[float], k: int = 5, metric: str = DOT
) -> DataFrame:
    """(id, distance, content) of the k chunks nearest to one query.

    The search runs once, into the checkpoint folder; its k ids then fetch the texts.
    """
    near = checkpointed(vector_topk(corpus, query, k, metric))
    wanted = near.select("id")
    texts = contents.join(F.broadcast(wanted) if k <= MAX_BROADCAST_ROWS else wanted, "id", "left_semi")
    return near.join(texts.select("id", "content"), "id", "left").select("id", "distance", "content")


def rag_context(
    corpus: DataFrame, contents: DataFrame, queries: DataFrame, k: int = 5, metric: str = DOT
) -> DataFrame:
    """(query_id, context, n_chunks, source_note) from the k nearest chunks of each query.

    ``corpus`` has (id, embedding), ``contents`` (id, content). The context lists
    ``[Context i]: chunk`` in distance order, separated by blank lines; it is empty for a query
    without hits. Only the texts of chunks that were found are moved.
    """
    near, bounded = topk_batch_sized(corpus, queries, k, metric)
    near = checkpointed(near)
    wanted = near.select("id")
    texts = contents.join(F.broadcast(wanted) if bounded else wanted, "id", "left_semi").select("id", "content")
    chunks = near.join(texts, "id", "left").groupBy("query_id").agg(
        # k entries per query.
        F.array_sort(F.collect_list(F.struct("rank", F.coalesce("content", F.lit("")).alias("content")))).alias("hits")
    )
    lines = F.transform(
        "hits", lambda hit: F.concat(F.lit("[Context "), hit["rank"].cast("string"), F.lit("]: "), hit["content"])
    )
    packed = chunks.select("query_id", F.array_join(lines, "\n\n").alias("context"), F.size("hits").alias("found"))
    n_chunks = F.coalesce("found", F.lit(0)).cast("bigint")
    return queries.select("query_id").join(packed, "query_id", "left").select(
        "query_id",
        F.coalesce("context", F.lit("")).alias("context"),
        n_chunks.alias("n_chunks"),
        F.concat(F.lit("[Source: "), n_chunks.cast("string"), F.lit(" chunks]")).alias("source_note"),
    )
