"""Lexical, vector and hybrid retrieval over chunks, for every repository at once.

A ranked list is a DataFrame (repository_id, file_path, chunk_index, distance, rank): smaller
distance is better, rank counts from 1 within a repository.  Ties are broken by path and
index, so a list is the same in every run.  Scores are rounded to nine digits before they are
compared: the order in which terms are summed then can't change a list.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import EMBED_TOKEN_PYTHON, TOKEN_PYTHON, intents, keywords, occurrences, path_priority, tokens
from ..sources.store import written
from .corpus import KEY

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60


KEYWORD, OKAPI, VECTOR = "keyword", "okapi", "vector"
#: A list of a plan: what it ranks by, and the question.
Wanted = list[tuple[str, str]]


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def _term_counts(own: Column, words: list[str]) -> Column:
    """The tokens among the words; most chunks have few, which makes counting them cheap."""
    return F.filter(own, lambda t: F.array_contains(_words(words), t))


def _terms(question: str) -> list[str]:
    """The words Okapi looks for: the keywords, or all words of a question that has none."""
    return keywords(question) or sorted(set(re.findall(TOKEN_PYTHON, question.lower())))


def _plain(ks: list[str], n: Column, path: Column) -> Column:
    """Sum over the keywords in path or content of 1 + 1.4 per occurrence up to ten, 2.5 more if in the path; n: occurrences in the order of ks."""
    one = F.zip_with(n, _words(ks), lambda c, k: F.when(c > 0, 1.0 + F.least(c, F.lit(10.0)) * 1.4 + F.when(F.instr(path, k) > 0, 2.5).otherwise(0.0)).otherwise(0.0))
    return F.aggregate(one, F.lit(0.0), lambda acc, x: acc + x)


def _saturated(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _found(tfs: Column) -> Column:
    """(i, tf) of the terms that occur; few of a question's terms do."""
    return F.filter(F.transform(tfs, lambda x, i: F.struct(i.alias("i"), x.alias("tf"))), lambda x: x["tf"] > 0)


def _repository_statistics(corpus: DataFrame, terms: list[str], okapi: bool) -> DataFrame:
    """(repository_id, average, content_average, idfs): mean token counts of searched texts and of contents, and inverse document
    frequencies of the terms, in one pass.

    Frequencies below 0 become a quarter of the mean over the repository's vocabulary, for which documents are counted
    for every term; only the questions' terms are kept.  Each chunk also counts under the term '', which no text has: that
    row of a repository has its documents and lengths.
    """
    own = corpus.select("repository_id", tokens(F.col("full_text")).alias("own"), F.size(tokens(F.col("file_path"))).alias("p"))
    every = F.array(F.lit(""))
    counted = F.array_union(every, F.col("own")) if okapi else every
    rows = own.select("repository_id", F.explode(counted).alias("term"), F.size("own").alias("length"), (F.size("own") - F.col("p")).alias("n"))
    by_term = rows.groupBy("repository_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("length").alias("lengths"), F.sum("n").alias("ns"))
    sizes = by_term.where("term = ''").select("repository_id", F.col("df").alias("docs"), (F.col("lengths") / F.col("df")).alias("average"), F.greatest(F.col("ns") / F.col("df"), F.lit(1.0)).alias("content_average"))
    if not okapi:
        return sizes.select("repository_id", "average", "content_average", F.lit(None).cast("map<string,double>").alias("idfs"))
    idf = by_term.where("term <> ''").join(sizes.select("repository_id", "docs"), "repository_id").withColumn("idf", F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mine = F.collect_list(F.when(F.col("term").isin(terms), F.struct("term", "idf")))  # at most one entry a term of the questions
    per = idf.groupBy("repository_id").agg((EPSILON * F.avg("idf")).alias("floor"), F.map_from_entries(mine).alias("idfs"))
    per = per.select("repository_id", F.transform_values("idfs", lambda _, v: F.when(v < 0, F.col("floor")).otherwise(v)).alias("idfs"))
    return sizes.join(per, "repository_id", "left").select("repository_id", "average", "content_average", "idfs")


def scored_chunks(corpus: DataFrame, wanted: Wanted, dimensions: int = 768) -> DataFrame:
    """The key of every chunk with one score for each list wanted, score_0, score_1, ...; higher is better.

    All lists are scored in one pass over the texts: a chunk is cut into tokens once, the terms of all questions are counted
    in it in place, and joined with one row of statistics a repository.  Keyword lists: keywords in the text, twice a BM25
    without weights for rarity (whose average length counts only content), and thrice the path's weight.  Okapi lists: BM25
    over path and content plus the path's weight.  Vector lists: the negative distance of hashed embeddings.
    """
    questions = list(dict.fromkeys(q for kind, q in wanted if kind != VECTOR))
    terms = sorted({w for q in questions for w in [*keywords(q), *_terms(q)]})
    at = {w: i for i, w in enumerate(terms)}
    path = F.lower("file_path")
    c = corpus.select(*KEY, "content", F.lower("full_text").alias("text"), tokens(F.col("full_text")).alias("own"))
    # tokens stand between two blanks each, so that neighbours don't share one; the counts are loops over words, not an
    # expression a word, which would make a method too long to be compiled
    c = c.select(*KEY, "content", "text", F.size("own").alias("length"), (F.size("own") - F.size(tokens(F.col("file_path")))).alias("n"), F.concat(F.lit(" "), F.array_join("own", "  "), F.lit(" ")).alias("line"))
    vectors = [q for kind, q in wanted if kind == VECTOR]
    ks = sorted({w for kind, q in wanted if kind == KEYWORD for w in keywords(q)})
    c = c.select(
        *KEY, "length", "n", F.transform(_words(ks), lambda w: occurrences(F.col("text"), w)).alias("seen"), _found(F.transform(_words([f" {w} " for w in terms]), lambda w: occurrences(F.col("line"), w))).alias("found"),
        *([_embedding_distances(F.col("content"), vectors, dimensions).alias("vectors")] if vectors else []),
    )
    if questions:
        c = c.join(_repository_statistics(corpus, terms, any(kind == OKAPI for kind, _ in wanted)), "repository_id")

    def bm25(words: list[str], weight, average: str) -> Column:
        mine = F.filter("found", lambda x: x["i"].isin([at[w] for w in words])) if len(words) < len(terms) else F.col("found")
        return F.aggregate(mine, F.lit(0.0), lambda acc, x: acc + weight(x) * _saturated(x["tf"], F.col("length"), F.col(average)))

    scores = []
    for kind, q in wanted:
        own, weight = keywords(q), path_priority(F.col("file_path"), intents(q))
        if kind == VECTOR:
            score = -F.col("vectors")[vectors.index(q)]
        elif kind == OKAPI:
            score = F.round(bm25(_terms(q), lambda x: F.coalesce(F.col("idfs")[F.element_at(_words(terms), x["i"] + 1)], F.lit(0.0)), "average") + weight, 9) if terms else F.round(weight, 9)
        elif own:
            seen = F.array(*[F.col("seen")[ks.index(w)] for w in own])
            score = F.round(_plain(own, seen, path) + weight + 2 * F.when(F.col("length") > 0, bm25(own, lambda x: F.lit(1.0), "content_average") + weight).otherwise(0.0), 9)
        else:
            score = F.lit(0.0)
        scores.append(score)
    return c.select(*KEY, *[x.alias(f"score_{i}") for i, x in enumerate(scores)])


def ranked_lists(corpus: DataFrame, wanted: Wanted, limit: int, dimensions: int = 768) -> DataFrame:
    """(key, list, distance, rank) of the limit best chunks of every list wanted in each repository, one shuffle for all.

    Keyword and Okapi lists hold scores above 0 only; in a vector list every chunk is a candidate.
    """
    scored = scored_chunks(corpus, wanted, dimensions)
    rows = F.array(*[F.struct(F.lit(i).alias("list"), F.col(f"score_{i}").alias("score"), F.lit(kind == VECTOR).alias("all")) for i, (kind, _) in enumerate(wanted)])
    long = scored.select(*KEY, F.explode(rows).alias("s")).where("s.score > 0 or s.all").select(*KEY, "s.list", "s.score")
    order = Window.partitionBy("repository_id", "list").orderBy(F.col("score").desc(), "file_path", "chunk_index")
    ranked = long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select(*KEY, "list", (-F.col("score")).alias("distance"), "rank")


def keyword_chunks(corpus: DataFrame, question: str, limit: int) -> DataFrame:
    """Ranked list by keyword score plus twice the saturation score, a BM25 without weights for rarity."""
    return ranked_lists(corpus, [(KEYWORD, question)], limit).drop("list")


def okapi_chunks(corpus: DataFrame, question: str, limit: int) -> DataFrame:
    """Ranked list by Okapi BM25 over path and content plus the path's weight."""
    return ranked_lists(corpus, [(OKAPI, question)], limit).drop("list")


def anchor_chunks(corpus: DataFrame, question: str, limit: int) -> DataFrame:
    """Front pages, installation guides, manifests and overviews at the repository's root, if the question shows an intent; else no rows."""
    own = intents(question)
    p, i = F.lower("file_path"), F.col("chunk_index")
    keep = ((p == "readme.md") & (i <= 6)) | (p.isin("package.json", "pyproject.toml", "setup.py", "go.mod") & (i <= 2))
    if "startup" in own:
        keep = keep | (p.isin("docs/install.md", "install.md") & (i <= 4))
    if "overview" in own:
        keep = keep | ((i <= 3) & p.rlike("overview|introduction|architecture"))
    order = Window.partitionBy("repository_id").orderBy(F.when(p == "readme.md", 0).otherwise(1), "file_path", "chunk_index")
    found = corpus.where(keep if own else F.lit(False)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return found.select(*KEY, (F.lit(-10000.0) + i).alias("distance"), "rank")


def fuse(lists: list[DataFrame] | DataFrame, limit: int) -> DataFrame:
    """Reciprocal-rank fusion: the sum of 1 / (60 + rank) over the lists; ties go to the list and rank a chunk is first met at.

    lists: ranked lists, or one table of them with a column list.
    """
    both = lists if isinstance(lists, DataFrame) else reduce(DataFrame.unionByName, [x.select(*KEY, "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)])
    # whole billionths add up exactly, whatever the order
    unit = F.round(F.lit(1e12) / (RRF_K + F.col("rank"))).cast("bigint")
    fused = both.groupBy(*KEY).agg(F.sum(unit).alias("points"), F.min(F.struct("list", "rank")).alias("first"))
    order = Window.partitionBy("repository_id").orderBy(F.col("points").desc(), "first")
    ranked = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select(*KEY, (-F.col("points") / F.lit(1e12)).alias("distance"), "rank")


def append(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """The first list, then what the second adds to it, cut to limit."""
    both = first.withColumn("list", F.lit(0)).unionByName(second.withColumn("list", F.lit(1)))
    one = both.groupBy(*KEY).agg(F.min(F.struct("list", "rank", "distance")).alias("first"))
    order = Window.partitionBy("repository_id").orderBy("first")
    ranked = one.select(*KEY, F.col("first.distance").alias("distance"), F.row_number().over(order).alias("rank"))
    return ranked.where(F.col("rank") <= limit)


def neighbours(selected: DataFrame, corpus: DataFrame, window: int, limit: int | None = None) -> DataFrame:
    """Each chunk of the list with those up to window before and after it in its file, in list order, each once.

    A neighbour takes the distance of the chunk that brought it.  Offsets are exploded, so the
    join is an equality join; a window of 0 or less returns the list.
    """
    if window <= 0:
        return selected
    near = selected.select("repository_id", "file_path", F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index"), "distance", F.col("rank").alias("by"))
    found = near.join(corpus.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.min(F.struct("by", "chunk_index", "distance")).alias("first"))
    order = Window.partitionBy("repository_id").orderBy("first.by", "chunk_index")
    out = found.select(*KEY, F.col("first.distance").alias("distance"), F.row_number().over(order).alias("rank"))
    return out if limit is None else out.where(F.col("rank") <= limit)


# -- vectors ------------------------------------------------------------------------


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two vectors of one length, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, v: acc + v)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 512) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest vectors by squared distance of every query, exact.

    Vectors are read once.  Queries are written beside the checkpoints; each task reads them from there in blocks
    of a fixed number, so none pass the driver and a task never holds them all.  Distances are matrix products, and a
    task keeps k candidates a query and batch, so what is shuffled doesn't grow with pairs.  Neighbours have the query's
    length; null vectors, queries and ids have none.  Of several queries under an id the greatest counts.
    vectors(vec_id, embedding), queries(query_id, embedding).
    """
    own = queries.where("query_id is not null and embedding is not null").select(F.col("query_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("embedding"))
    files = sorted(written(own.groupBy("query_id").agg(F.max("embedding").alias("embedding"))).inputFiles())

    def of_length(column):
        import numpy as np

        rows: dict[int, list[int]] = {}
        values = column.to_pylist()
        for i, x in enumerate(values):
            if x is not None and None not in x:
                rows.setdefault(len(x), []).append(i)
        return {n: (np.asarray(at), np.asarray([values[i] for i in at], np.float64).reshape(len(at), n)) for n, at in rows.items()}

    def search(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem

        for b in batches:
            ids, held = np.asarray(b.column(0).to_pylist(), np.int64), of_length(b.column(1))
            for uri in files if held else ():
                fs, path = FileSystem.from_uri(uri)
                with fs.open_input_file(path) as f:
                    for part in pq.ParquetFile(f).iter_batches(batch_size=block):
                        qids = np.asarray(part.column(0).to_pylist(), np.int64)
                        for n, (at, q) in of_length(part.column(1)).items():
                            if n not in held:
                                continue
                            mine, v = held[n]
                            d = np.round((q**2).sum(1)[:, None] + (v**2).sum(1)[None] - 2 * q @ v.T, 9)
                            d = np.maximum(d, 0.0)
                            keep = np.lexsort((np.broadcast_to(ids[mine], d.shape), d), axis=1)[:, :k]
                            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids[at], keep.shape[1])), pa.array(ids[mine][keep].ravel()), pa.array(np.take_along_axis(d, keep, 1).ravel())], ["query_id", "vec_id", "distance"])

    found = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(search, "query_id bigint, vec_id bigint, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def embed(text: str | None, dimensions: int) -> list[float]:
    """Hashed bag of tokens: each token adds or subtracts 1 in the place its digest gives; unit length, zero without tokens."""
    out = [0.0] * dimensions
    for t in re.findall(EMBED_TOKEN_PYTHON, (text or "").lower()):
        d = hashlib.blake2b(t.encode(), digest_size=8).digest()
        out[int.from_bytes(d[:4], "little") % dimensions] += 1.0 if d[4] % 2 == 0 else -1.0
    norm = sum(x * x for x in out) ** 0.5
    return [x / norm for x in out] if norm else out


def hash_embedding(text: Column, dimensions: int = 768) -> Column:
    """embed() as a column of array<float>; null text is read as ''."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts):
        import pandas as pd

        return pd.Series([embed(t, dimensions) for t in texts])

    return run(text)


def _embedding_distances(text: Column, questions: list[str], dimensions: int) -> Column:
    """Squared distances of a text's hashed embedding to the questions', without building the vectors: for unit vectors
    it is 2 - 2 * dot, and the dot product only needs the places where the question isn't 0."""
    targets = [embed(q, dimensions) for q in questions]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts):
        import pandas as pd

        kept: dict[str, tuple[int, float]] = {}
        out = []
        for t in texts:
            places: dict[int, float] = {}
            for w in re.findall(EMBED_TOKEN_PYTHON, (t or "").lower()):
                if (at := kept.get(w)) is None:
                    if len(kept) > 500_000:
                        kept.clear()
                    d = hashlib.blake2b(w.encode(), digest_size=8).digest()
                    at = kept[w] = (int.from_bytes(d[:4], "little") % dimensions, 1.0 if d[4] % 2 == 0 else -1.0)
                places[at[0]] = places.get(at[0], 0.0) + at[1]
            norm = sum(x * x for x in places.values()) ** 0.5
            dots = [sum(x * target[i] for i, x in places.items()) / norm if norm else 0.0 for target in targets]
            out.append([round((1.0 if norm else 0.0) + (1.0 if any(target) else 0.0) - 2 * dot, 9) for target, dot in zip(targets, dots, strict=True)])
        return pd.Series(out)

    return run(text)


def vector_chunks(corpus: DataFrame, question: str, limit: int, dimensions: int = 768) -> DataFrame:
    """Ranked list by the distance of hashed embeddings; every chunk is a candidate."""
    return ranked_lists(corpus, [(VECTOR, question)], limit, dimensions).drop("list")


# -- pipelines ----------------------------------------------------------------------


def hybrid(corpus: DataFrame, questions: list[str], k: int = 10, candidates: int = 30, window: int = 1) -> DataFrame:
    """Anchors, then the fusion of keyword, fused Okapi and fused vector lists, cut, widened by neighbours and cut again.

    The first question is the primary one; anchors and keywords use it alone.  Blank questions are left out.
    """
    qs = [q for q in questions if q.strip()]
    if not qs:
        return anchor_chunks(corpus, "", k)
    candidates = max(candidates, k)
    n = len(qs)
    lists = ranked_lists(corpus, [(KEYWORD, qs[0]), *[(OKAPI, q) for q in qs], *[(VECTOR, q) for q in qs]], candidates)
    okapi, vector = fuse(lists.where(F.col("list").between(1, n)), candidates), fuse(lists.where(F.col("list") > n), candidates)
    fused = fuse([lists.where("list = 0"), okapi, vector], candidates)
    selected = append(anchor_chunks(corpus, qs[0], k), fused, candidates)
    return neighbours(selected, corpus, window, candidates)


def hybrid_online(corpus: DataFrame, questions: list[str], k: int = 10, candidates: int = 30, window: int = 1) -> DataFrame:
    """The pipeline without vectors: one fusion over the keyword and Okapi lists of all questions."""
    qs = [q for q in questions if q.strip()]
    if not qs:
        return anchor_chunks(corpus, "", k)
    candidates = max(candidates, k)
    lists = ranked_lists(corpus, [*[(KEYWORD, q) for q in qs], *[(OKAPI, q) for q in qs]], candidates)
    selected = append(anchor_chunks(corpus, qs[0], k), fuse(lists, candidates), candidates)
    return neighbours(selected, corpus, window, candidates)


def rerank(ranked: DataFrame, corpus: DataFrame, question: str, limit: int = 10) -> DataFrame:
    """The list ordered anew by retrieval score and features of path, symbol and content; adds rerank_score and retrieval_rank."""
    ks, q = keywords(question), question.lower().strip()
    c = ranked.join(corpus, KEY)
    path, symbol, content = F.col("file_path"), F.coalesce("symbol_name", F.lit("")), F.col("content")
    own = _term_counts(F.concat(tokens(content), tokens(path), tokens(symbol)), ks)

    def feature(acc: Column, k: Column) -> Column:
        n = F.size(F.filter(own, lambda t: t == k))
        score = acc["score"] + F.when(n > 0, 3.0 + F.least(n, F.lit(8)) * 1.3).otherwise(0.0) + F.when(F.instr(F.lower(path), k) > 0, 5.0).otherwise(0.0)
        score = score + F.when((symbol != "") & (F.instr(F.lower(symbol), k) > 0), 6.0).otherwise(0.0)
        return F.struct(score.alias("score"), (acc["hits"] + (n > 0).cast("int")).alias("hits"))

    sums = F.aggregate(_words(ks), F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("hits")), feature)
    score = F.greatest(F.lit(0.0), -F.col("distance")) * 28.0 + path_priority(path, intents(question)) * 1.7
    if q:
        score = score + F.when(F.instr(F.lower(F.concat_ws("\n", path, symbol, content)), q) > 0, 18.0).otherwise(0.0)
    if ks:
        score = score + F.col("sums.score") + F.col("sums.hits") / len(ks) * 24.0
    score = score + F.when(symbol != "", 4.0).otherwise(0.0) + F.when(F.col("symbol_type").isin("class", "function", "section"), 2.0).otherwise(0.0)
    score = score + F.when((F.col("start_line") != 0) & (F.col("end_line") != 0), 1.0).otherwise(0.0)
    score = score - F.when(F.length(content) > 7000, 6.0).when(F.greatest(F.length(content), F.lit(1)) < 120, 3.0).otherwise(0.0)
    scored = c.withColumn("sums", sums).select(*KEY, "distance", F.col("rank").alias("retrieval_rank"), F.round(score, 6).alias("rerank_score"))
    order = Window.partitionBy("repository_id").orderBy(F.col("rerank_score").desc(), "retrieval_rank")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def rescore(ranked: DataFrame, scores: DataFrame, least: float = 4.0, default: float = 5.0) -> DataFrame:
    """Keeps the chunks whose outside score, or the default without one, is at least least; a list that would end empty stays.

    scores(repository_id, file_path, chunk_index, outside_score): the greatest of several scores counts, scores are held to 1..10.
    """
    best = scores.groupBy(*KEY).agg(F.max(F.greatest(F.least("outside_score", F.lit(10.0)), F.lit(1.0))).alias("outside_score"))
    joined = ranked.join(best, KEY, "left").withColumn("outside_score", F.coalesce("outside_score", F.lit(default)))
    best_here = F.max("outside_score").over(Window.partitionBy("repository_id"))
    kept = joined.withColumn("best", best_here).where((F.col("outside_score") >= least) | (F.col("best") < least))
    order = Window.partitionBy("repository_id").orderBy(F.when(F.col("best") >= least, -F.col("outside_score")).otherwise(0.0), "rank")
    return kept.withColumn("new_rank", F.row_number().over(order)).select(*KEY, "distance", "outside_score", F.col("new_rank").alias("rank"))
