"""Retrieval against brute force in plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lucerna.functions import text as TX
from lucerna.operators import retrieval as R
from lucerna.operators.corpus import searchable, unique_chunks

QUESTION = "install overview of the token cache"


def _tokens(t):
    return re.findall(TX.TOKEN_PYTHON, t.lower())


def _priority(path, own):
    p, over = path.lower(), "overview" in own
    s = (42 if over else 18) if p == "readme.md" else (6 if over else 9) if "readme" in p else 0
    s -= 8 * (over and p.count("/") >= 2 and p.endswith("readme.md"))
    s += 5 * any(w in p for w in ("overview", "introduction", "architecture", "guide", "docs/", "spec"))
    s += 5 * any(w in p for w in ("quickstart", "install", "contributing", "development"))
    s += 3 * p.endswith(("pyproject.toml", "setup.py", "requirements.txt", "mkdocs.yml", "package.json"))
    s -= 6 * any(w in p for w in ("test", "snapshot", "fixture", "locale", "/de/", "/ru/", "/uk/", "/ko/"))
    return s - 4 * (over and any(w in p for w in ("tool", "lint", "bench", "script")))


PATHS = ["README.md", "docs/a/README.md", "docs/install.md", "src/cache.py", "tests/test_cache.py", "package.json", "tools/lint.py", "guide/ru/overview.md", "setup.py", "x/Introduction.txt"]


@pytest.fixture(scope="module")
def corpus(spark, chunks_of):
    rng = random.Random(4)
    words = "token cache install run report the of a cachetoken 模块 数据 x1 report_2 overview".split()
    rows = [{"repo": f"r{k}", "path": p, "index": i, "name": rng.choice(["cache", "", None]), "type": rng.choice(["function", "text"]), "content": " ".join(rng.choices(words, k=rng.randrange(0, 40)))} for k in range(2) for p in PATHS for i in range(rng.randrange(1, 5))]
    rows += [{"repo": "r0", "path": "src/null.py", "content": None}, {"repo": None, "path": "a", "content": "token"}, {"repo": "r2", "path": "only.txt", "content": ""}, dict(rows[0])]
    c = searchable(chunks_of(rows).withColumn("rank", F.lit(1)).withColumn("score", F.lit(2))).cache()
    return c, [r.asDict() for r in c.collect()]


def _ranked(df):
    return {r: [(x.file_path, x.chunk_index, round(x.distance, 6)) for x in sorted(df.where(f"repository_id = '{r}'").collect(), key=lambda x: x.rank)] for r in ("r0", "r1", "r2")}


def _best(rows, score, limit):
    out = {}
    for r in ("r0", "r1", "r2"):
        s = [(round(score(x, [y for y in rows if y["repository_id"] == r]), 9), x) for x in rows if x["repository_id"] == r]
        s = sorted([(v, x) for v, x in s if v > 0], key=lambda v: (-v[0], v[1]["file_path"], v[1]["chunk_index"]))[:limit]
        out[r] = [(x["file_path"], x["chunk_index"], round(-v, 6)) for v, x in s]
    return out


def test_path_priority(spark):
    own = TX.intents(QUESTION)
    df = spark.createDataFrame([(p,) for p in [*PATHS, "a/b/readme.md", "mkdocs.yml", "scripts/x"]], "p string")
    for i in (own, set(), {"startup"}):
        assert all(r.s == _priority(r.p, i) for r in df.select("p", TX.path_priority(F.col("p"), i).alias("s")).collect())


def test_keyword_chunks(corpus):
    c, rows = corpus
    ks, own = TX.keywords(QUESTION), TX.intents(QUESTION)

    def score(x, all_):
        text, path = x["full_text"].lower(), x["file_path"].lower()
        s = sum(1 + min(text.count(k), 10) * 1.4 + 2.5 * (k in path) for k in ks if k in text) + _priority(path, own)
        avg = max(sum(len(_tokens(y["content"])) for y in all_) / len(all_), 1)
        t = Counter(_tokens(x["full_text"]))
        n = sum(t.values())
        return s + 2 * (sum(t[k] * 2.5 / (t[k] + 1.5 * (0.25 + 0.75 * n / avg)) for k in ks if t[k]) + _priority(path, own))

    assert _ranked(R.keyword_chunks(c, QUESTION, 12)) == _best(rows, score, 12)


@pytest.mark.parametrize("question", [QUESTION, "token the", "zzz"])
def test_okapi(corpus, question):
    c, rows = corpus
    ks, own = TX.keywords(question), TX.intents(question)

    def score(x, all_):
        docs = [Counter(_tokens(y["full_text"])) for y in all_]
        df = Counter(t for d in docs for t in d)
        idf = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
        floor = 0.25 * sum(idf.values()) / len(idf)
        avg = sum(sum(d.values()) for d in docs) / len(docs)
        t = Counter(_tokens(x["full_text"]))
        n = sum(t.values())
        return sum((floor if idf[k] < 0 else idf[k]) * t[k] * 2.5 / (t[k] + 1.5 * (0.25 + 0.75 * n / avg)) for k in ks if t[k]) + _priority(x["file_path"], own)

    assert _ranked(R.okapi_chunks(c, question, 12)) == _best(rows, score, 12)


def test_anchors_dominate_reranking(corpus):
    c, _ = corpus
    a = _ranked(R.anchor_chunks(c, QUESTION, 10))
    assert a["r0"][0][0] == "README.md" and all(d <= -9990 for _, _, d in a["r0"]) and R.anchor_chunks(c, "zzz", 10).count() == 0
    both = R.hybrid_online(c, [QUESTION, " ", "token"])
    first = R.rerank(both, c, QUESTION).where("rank = 1 and repository_id = 'r0'").first()
    assert first.file_path in ("README.md", "docs/install.md", "package.json", "setup.py", "guide/ru/overview.md", "x/Introduction.txt") and first.rerank_score > 200_000
    full = R.hybrid(c, [QUESTION, "token"])
    assert full.groupBy("repository_id").count().where("count > 30").count() == 0
    assert R.hybrid(c, []).count() == 0 and R.keyword_chunks(c.limit(0), QUESTION, 5).count() == 0


LIST = st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 4)), unique=True, max_size=6)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(LIST, min_size=1, max_size=3), st.integers(1, 8), st.integers(0, 2))
def test_fusion_and_neighbours(spark, lists, limit, window):
    schema = "repository_id string, file_path string, chunk_index int, distance double, rank int"
    make = lambda x: spark.createDataFrame([("r", p, i, -1.0 / k, k) for k, (p, i) in enumerate(x, 1)], schema)
    points, first = {}, {}
    for n, x in enumerate(lists):
        for k, key in enumerate(x, 1):
            points[key] = points.get(key, 0) + round(1e12 / (60 + k))
            first.setdefault(key, (n, k))
    want = sorted(points, key=lambda key: (-points[key], first[key]))[:limit]
    got = R.fuse([make(x) for x in lists], limit)
    assert [(r.file_path, r.chunk_index) for r in sorted(got.collect(), key=lambda r: r.rank)] == want
    have = spark.createDataFrame([("r", p, i) for p in "ab" for i in range(4)], "repository_id string, file_path string, chunk_index int")
    out, seen = [], set()
    for p, i in lists[0]:
        for j in range(i - window, i + window + 1):
            if (window <= 0 or 0 <= j < 4) and (p, j) not in seen:
                seen.add((p, j))
                out.append((p, j))
    got = R.neighbours(make(lists[0]), have, window)
    assert [(r.file_path, r.chunk_index) for r in sorted(got.collect(), key=lambda r: r.rank)] == out


def test_outside_scores(spark):
    schema = "repository_id string, file_path string, chunk_index int, distance double, rank int"
    ranked = spark.createDataFrame([("r", "a", i, -1.0, i + 1) for i in range(4)] + [("q", "a", i, -1.0, i + 1) for i in range(2)], schema)
    scores = spark.createDataFrame([("r", "a", 0, 3.0), ("r", "a", 1, 9.0), ("r", "a", 1, 2.0), ("r", "a", 3, 99.0), ("q", "a", 0, 1.0), ("q", "a", 1, 2.0)], "repository_id string, file_path string, chunk_index int, outside_score double")
    got = sorted((r.repository_id, r.rank, r.chunk_index, r.outside_score) for r in R.rescore(ranked, scores).collect())
    assert got == [("q", 1, 0, 1.0), ("q", 2, 1, 2.0), ("r", 1, 3, 10.0), ("r", 2, 1, 9.0), ("r", 3, 2, 5.0)]


def test_nearest(spark):
    rng = random.Random(2)
    vs = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(60)] + [(100, None), (101, [1.0]), (5, [0.0] * 4)]
    v = spark.createDataFrame(vs, "vec_id bigint, embedding array<float>")
    q = spark.createDataFrame([(i, e) for i, e in vs[:6]] + [(50, None)], "query_id bigint, embedding array<float>")
    want = set()
    for i, e in vs[:6]:
        near = sorted({(sum((a - b) ** 2 for a, b in zip(e, x, strict=True)), j) for j, x in vs if x and len(x) == 4})[:5]
        want |= {(i, j, d, k) for k, (d, j) in enumerate(near, 1)}
    got = {(r.query_id, r.vec_id, r.distance, r.rank) for r in R.nearest(v, q, 5).collect()}
    assert got == want == {(r.query_id, r.vec_id, r.distance, r.rank) for r in R.nearest(v, q, 5, block=2).collect()}
    assert R.nearest(v.limit(0), q, 5).count() == 0 and R.nearest(v, q.limit(0), 5).count() == 0


def test_hash_embedding(spark, corpus):
    c, rows = corpus
    e = R.embed("Token token 模块数据 12", 64)
    assert abs(sum(x * x for x in e) - 1) < 1e-9 and R.embed("", 8) == [0.0] * 8
    assert spark.createDataFrame([("Token token 模块数据 12",), (None,)], "t string").select(R.hash_embedding(F.col("t"), 64).alias("e")).collect()[0].e == pytest.approx(e, abs=1e-6)
    q = R.embed("token cache", 768)
    want = {r: sorted((round(sum((a - b) ** 2 for a, b in zip(R.embed(x["content"], 768), q, strict=True)), 6), x["file_path"], x["chunk_index"]) for x in rows if x["repository_id"] == r)[:5] for r in ("r0", "r1")}
    got = R.vector_chunks(c, "token cache", 5).collect()
    for r in want:
        mine = sorted((x.rank, round(x.distance, 6)) for x in got if x.repository_id == r)
        assert [d for _, d in mine] == pytest.approx([d for d, _, _ in want[r]], abs=1e-5)


def test_unique_chunks(spark, chunks_of):
    rows = [{"path": "a", "content": "x"}, {"path": "a", "content": None}, {"path": "a", "content": "y", "name": None}, {"path": "a", "content": "y", "name": "n"}, {"path": None, "content": "z"}]
    got = unique_chunks(chunks_of(rows).withColumn("r", F.lit(1))).collect()
    assert len(got) == 1 and got[0].content == "y" and got[0].symbol_name == "n"
