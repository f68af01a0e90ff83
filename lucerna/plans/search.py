"""Registered retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import retrieval as R
from ..operators.corpus import KEY, searchable
from ..sources.tables import read
from . import oracle as O

QUESTION = "How do I install and run the report cache module?"
SECOND = "where is the pipeline token validated"


def _corpus(s: SparkSession, d: str) -> DataFrame:
    return searchable(read(s, d, "chunks"))


def _show(ranked: DataFrame) -> DataFrame:
    return ranked.select(*KEY, "distance", F.col("rank").cast("bigint").alias("rank"))


def token_counts(s, d):
    """Occurrences and chunks of every token."""
    c = _corpus(s, d).select(*KEY, F.explode(tokens(F.col("full_text"))).alias("token"))
    per = c.groupBy(*KEY, "token").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("chunks"))


def doc_length_stats(s, d):
    """Chunks and mean token counts of content and searched text per repository."""
    c = _corpus(s, d).select("repository_id", F.size(tokens(F.col("content"))).alias("n"), F.size(tokens(F.col("full_text"))).alias("m"))
    return c.groupBy("repository_id").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("n"), 6).alias("content_tokens"), F.round(F.avg("m"), 6).alias("searched_tokens"))


def fused(s, d):
    c = _corpus(s, d)
    return _show(R.fuse(R.ranked_lists(c, [(R.KEYWORD, QUESTION), (R.OKAPI, QUESTION)], 30), 30))


def neighbour_expand(s, d):
    c = _corpus(s, d)
    return _show(R.neighbours(R.okapi_chunks(c, SECOND, 5), c, 1, 30))


def local_rerank(s, d):
    c = _corpus(s, d)
    out = R.rerank(R.keyword_chunks(c, SECOND, 30), c, SECOND)
    return out.select(*KEY, "rerank_score", F.col("retrieval_rank").cast("bigint").alias("retrieval_rank"), F.col("rank").cast("bigint").alias("rank"))


def outside_scores(s, d):
    """Scores from outside are stood in for by the chunk's length class."""
    c = _corpus(s, d)
    scores = c.where(F.col("chunk_index") != 1).select(*KEY, (F.length("content") % 10 + 1).cast("double").alias("outside_score"))
    return R.rescore(R.okapi_chunks(c, SECOND, 10), scores).select(*KEY, "outside_score", F.col("rank").cast("bigint").alias("rank"))


def vector_knn(s, d):
    v = read(s, d, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.nearest(v, q, 10).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


def hash_embedding(s, d):
    """Hashed embedding of every chunk, shown by its length and its number of places in use."""
    c = _corpus(s, d).select(*KEY, R.hash_embedding(F.col("content"), 256).alias("e"))
    return c.select(*KEY, F.size("e").alias("dimensions"), F.size(F.filter("e", lambda x: x != 0)).alias("places"))


def queries():
    return {
        "token_counts": token_counts,
        "doc_length_stats": doc_length_stats,
        "keyword_topk": lambda s, d: _show(R.keyword_chunks(_corpus(s, d), QUESTION, 30)),
        "bm25_okapi_topk": lambda s, d: _show(R.okapi_chunks(_corpus(s, d), QUESTION, 30)),
        "anchor_select": lambda s, d: _show(R.anchor_chunks(_corpus(s, d), QUESTION, 10)),
        "rrf_fusion": fused,
        "neighbor_expand": neighbour_expand,
        "hybrid_online": lambda s, d: _show(R.hybrid_online(_corpus(s, d), [QUESTION, SECOND])),
        "hybrid_persistent": lambda s, d: _show(R.hybrid(_corpus(s, d), [QUESTION, SECOND])),
        "local_rerank": local_rerank,
        "outside_score_merge": outside_scores,
        "vector_knn": vector_knn,
        "hash_embedding": hash_embedding,
        "hash_vector_topk": lambda s, d: _show(R.vector_chunks(_corpus(s, d), SECOND, 30)),
    }


def oracle_sql():
    show = "SELECT repository_id, file_path, chunk_index, distance, rank FROM {}"

    def of(last: str, *parts: str) -> str:
        return "WITH " + ", ".join([O.CHUNKS, *parts]) + show.format(last)

    return {
        "token_counts": f"WITH {O.CHUNKS}, t AS (SELECT repository_id, file_path, chunk_index, unnest(regexp_extract_all(lower(full_text), '{O.TOKEN}')) AS token FROM c) "
        "SELECT token, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS chunks FROM (SELECT repository_id, file_path, chunk_index, token, count(*) AS n FROM t GROUP BY 1, 2, 3, 4) GROUP BY 1",
        "doc_length_stats": f"WITH {O.CHUNKS} SELECT repository_id, count(*) AS chunks, round(avg(len(regexp_extract_all(lower(content), '{O.TOKEN}'))), 6) AS content_tokens, "
        f"round(avg(len(regexp_extract_all(lower(full_text), '{O.TOKEN}'))), 6) AS searched_tokens FROM c GROUP BY 1",
        "keyword_topk": of("k", O.keyword_list("k", QUESTION, 30)),
        "bm25_okapi_topk": of("o", O.okapi_list("o", QUESTION, 30)),
        "anchor_select": of("a", O.anchor_list("a", QUESTION, 10)),
        "rrf_fusion": of("r", O.keyword_list("k", QUESTION, 30), O.okapi_list("o", QUESTION, 30), O.fused_list("r", ["k", "o"], 30)),
        "neighbor_expand": of("n", O.okapi_list("o", SECOND, 5), O.neighbour_list("n", "o", 1, 30)),
        "hybrid_online": of(
            "n", O.anchor_list("a", QUESTION, 10), O.keyword_list("k1", QUESTION, 30), O.keyword_list("k2", SECOND, 30), O.okapi_list("o1", QUESTION, 30), O.okapi_list("o2", SECOND, 30),
            O.fused_list("r", ["k1", "k2", "o1", "o2"], 30), O.appended_list("s", "a", "r", 30), O.neighbour_list("n", "s", 1, 30),
        ),
        "local_rerank": "WITH " + ", ".join([O.CHUNKS, O.keyword_list("k", SECOND, 30), O.reranked("r", "k", SECOND, 10)]) + " SELECT repository_id, file_path, chunk_index, rerank_score, retrieval_rank, rank FROM r",
        "outside_score_merge": "WITH " + ", ".join([O.CHUNKS, O.okapi_list("o", SECOND, 10)]) + """,
j AS (SELECT o.*, CASE WHEN c.chunk_index <> 1 THEN CAST(length(content) % 10 + 1 AS DOUBLE) ELSE 5.0::DOUBLE END AS outside_score FROM o JOIN c USING (repository_id, file_path, chunk_index)),
b AS (SELECT *, max(outside_score) OVER (PARTITION BY repository_id) AS best FROM j)
SELECT repository_id, file_path, chunk_index, outside_score, row_number() OVER (PARTITION BY repository_id ORDER BY CASE WHEN best >= 4 THEN -outside_score ELSE 0 END, rank) AS rank FROM b WHERE outside_score >= 4 OR best < 4""",
        "vector_knn": """WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 9) AS distance
FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) WHERE rank <= 10""",
    }
