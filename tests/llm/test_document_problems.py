"""Problems 6 to 8: leaked items, mixtures, abuse."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lucerna.llm import abuse, leakage, mixing

DOCS = "doc_id bigint, text string, source string"


def _words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n)]


def _altered_least(item, doc):
    """Brute force: does the document hold 18 words of the item in a row with at most one in ten altered?"""
    for i in range(len(item)):
        for length in range(18, len(item) - i + 1):
            part = item[i : i + length]
            for j in range(len(doc) - length + 1):
                if sum(a != b for a, b in zip(part, doc[j : j + length], strict=True)) * 10 <= length:
                    return True
    return False


def test_leaks(spark):
    intro = "Answer the question below in one sentence. "
    items = {i: _words(i, 50) for i in range(4)}
    table = spark.createDataFrame([(i, "qa", intro + " ".join(w)) for i, w in items.items()] + [(9, None, None), (None, "qa", intro), (0, "qa", intro + " ".join(items[0]))], "item_id bigint, suite string, text string")
    filler = _words(99, 30)
    alter = lambda ws, every: [("changed" if k % every == every - 1 else w) for k, w in enumerate(ws)]
    docs = {
        1: " ".join([*filler, *items[0], *filler]), 2: "> **" + "** \n> - ".join(w.upper() + "," for w in items[1][5:25]) + "</b>", 3: " ".join([*filler, *items[2][10:22], *filler]), 4: intro * 3, 5: " ".join(alter(items[3], 10)), 6: " ".join(alter(items[3], 4)),
        7: " ".join(items[0][:18]), 8: " ".join(items[0][:17]), 10: "", 11: " ".join(items[0][:25] + filler + items[1][20:45]),
    }
    d = spark.createDataFrame([(k, t, "s") for k, t in docs.items()] + [(12, None, None), (1, docs[1], "s")], DOCS).withColumn("item_id", F.lit(7))
    found = {(r.doc_id, r.item_id) for r in leakage.leaks(d, table).collect()}
    want = {(k, i) for k, t in docs.items() for i, ws in items.items() if _altered_least(ws, [w for w, _, _ in leakage.words(t)])}
    assert found == want == {(1, 0), (2, 1), (5, 3), (7, 0), (11, 0), (11, 1)}
    clean = {r.doc_id: r.text for r in leakage.cleaned(d.drop("item_id"), table).collect()}
    assert clean[1].split() == [*filler, *filler] and set(clean) == {1, 2, 5, 7, 11}
    per = {r.item_id: r.docs for r in leakage.leaks_by_item(d.drop("item_id"), table).collect()}
    assert per[0] == 3 and per[2] == 0 and per[9] == 0
    assert leakage.leaks(d.limit(0), table).count() == 0 and leakage.leaks(d, table.limit(0)).count() == 0


def test_short_items(spark):
    """Items of fewer than 18 words count as a whole, one altered word in ten allowed; the shortest word for word."""
    items = {n: _words(n + 500, n) for n in (1, 3, 5, 8, 9, 10, 13, 17)}
    table = spark.createDataFrame([(n, f"s{n}", " ".join(ws)) for n, ws in items.items()], "item_id bigint, suite string, text string")
    filler = _words(7, 25)
    docs, want = [], set()
    for n, ws in items.items():
        for k in range(n):  # each word altered once
            docs.append((n * 1000 + k, " ".join([*filler, *ws[:k], "altered", *ws[k + 1 :], *filler]), "s"))
            if n >= 10:
                want.add((n * 1000 + k, n))
        docs += [(n * 1000 + 900, " ".join([*filler, *ws, *filler]), "s"), (n * 1000 + 901, " ".join([*filler, *ws[:-1], *filler]), "s")]
        want |= {(n * 1000 + 900, n)}
        if n >= 10:
            want.add((n * 1000 + 901, n))  # the last word altered
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(spark.createDataFrame(docs, DOCS), table).collect()}
    assert got == want


def test_all_passages_are_removed(spark):
    item, filler = _words(31, 60), _words(32, 40)
    table = spark.createDataFrame([(1, "s", " ".join(item))], "item_id bigint, suite string, text string")
    twice = [*filler, *item, *filler, *item, *filler[:5], *item[10:35], *filler]
    broken = [*filler, *item[:20], *_words(33, 15), *item[30:60], *filler]
    hidden = [*item[:25], *filler, *[w if k % 10 != 9 else "altered" for k, w in enumerate(item[20:50])], *filler]
    d = spark.createDataFrame([(1, " ".join(twice), "s"), (2, " ".join(broken), "s"), (3, " ".join(hidden), "s")], DOCS)
    left = {r.doc_id: r.text.split() for r in leakage.cleaned(d, table).collect()}
    assert left[1] == [*filler, *filler, *filler[:5], *filler] and left[2] == [*filler, *_words(33, 15), *filler] and [w for w in left[3] if w in item] == []


def test_least_hits():
    """No passage that counts has fewer hits than asked for, wherever words are altered."""
    for n in range(5, 60):
        for length in range(leakage.least_words(n), n + 1):
            kept = length - leakage.GRAM + 1 - leakage.GRAM * (length // leakage.PER_ALTERED)
            assert leakage.least_hits(n) <= max(1, kept)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [(i, "s", " ".join(_words(i, 40))) for i in range(12)]
    table = spark.createDataFrame(items, "item_id bigint, suite string, text string")
    d = spark.createDataFrame([(i, t, "s") for i, _, t in items], DOCS)
    whole = sorted(map(tuple, leakage.leaks(d, table).collect()))
    monkeypatch.setattr(leakage, "GRAMS_PER_BLOCK", 60)
    assert sorted(map(tuple, leakage.leaks(d, table).collect())) == whole == [(i, i) for i in range(12)]


def test_mixture(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "index", "table"], k=rng.randrange(5, 60))), rng.choice(["Big Source", "big-source", " big_source", "small", None])) for i in range(600)]
    docs += [(1000, None, "small"), (1001, "", "small"), (1002, "alpha beta", "rare"), (0, "later", "small"), (None, "alpha", "small")]
    d = spark.createDataFrame(docs, DOCS)
    targets = spark.createDataFrame([("big_source", 0.3, 1), ("small", 0.5, 3), ("rare", 0.1, 4), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    rows = mixing.mix(d, targets).collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.doc_id for r in rows} <= {i for i, t, s in docs if t and s}
    used, cap = defaultdict(int), {"big_source": 1, "small": 3, "rare": 4}
    repeats = defaultdict(set)
    for r in rows:
        used[r.source] += r.tokens * r.repeats
        repeats[r.source].add(r.repeats)
        assert 1 <= r.repeats <= cap[r.source]
    plan = {r.source: r for r in mixing.shares(d, targets).collect()}
    for s, n in used.items():
        assert n == plan[s].used <= plan[s].budget
        assert plan[s].budget - n < 80 or plan[s].most_uses == cap[s]  # short of the budget by less than a document, or at the cap
    assert len(repeats["small"]) <= 2  # complete epochs first
    assert plan["absent"].used == 0 and plan["rare"].most_uses == 4 and abs(sum(p.actual_share for p in plan.values()) - 1) < 1e-4 and plan[None].used == 0
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(d, targets).collect()))  # repeatable
    assert mixing.mix(d.limit(0), targets).count() == 0 and mixing.mix(d, targets.limit(0)).count() == 0


def _filled(total, sources):
    """Brute force: the common level at which the sources' gifts add up to the total, by bisection."""
    give = lambda x: {s: min(a * r, share * x) if share > 0 else 0 for s, (a, share, r) in sources.items()}
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(give(mid).values()) < total else (lo, mid)
    return give(hi)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5000), st.sampled_from([0.0, 0.1, 0.25, 0.4]), st.integers(0, 4)), min_size=1, max_size=7), st.integers(0, 20_000))
def test_budgets_fill_up(spark, sources, total):
    named = {f"s{i}": x for i, x in enumerate(sources)}
    t = spark.createDataFrame([(s, a, p, r) for s, (a, p, r) in named.items()], "source string, available bigint, target_share double, max_repeats int")
    got = {r.source: r.budget for r in mixing._budgets(t, F.lit(total).cast("bigint")).collect()}
    want = _filled(total, named)
    assert all(abs(got[s] - want[s]) <= 1.01 for s in named)


def test_total_is_met(spark):
    """What an unreachable source can't give, the others give: the total is short by less than a document a source."""
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.col("id") % 7) for i in range(12)]).alias("text"), F.when(F.col("id") < 100, "few").when(F.col("id") < 1500, "many").otherwise("most").alias("source"))
    t = spark.createDataFrame([("few", 0.6, 2), ("many", 0.2, 2), ("most", 0.2, 3)], "source string, target_share double, max_repeats int")
    longest = d.select(F.max(mixing.sizes(F.col("text"))["tokens"])).first()[0]
    rows = {r.source: r for r in mixing.shares(d, t, 60_000).collect()}
    assert rows["few"].used == 2 * rows["few"].available and 0 <= 60_000 - sum(r.used for r in rows.values()) <= 2 * longest + 3
    assert abs(rows["many"].used - rows["most"].used) <= 2 * longest


def test_quality_weights_matter(spark):
    """Documents of twice the weight are taken first about two times in three."""
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat_ws(" ", *[F.lit(f"w{i}") for i in range(20)])).otherwise(F.concat_ws(" ", *[F.lit(f"w{i % 10}") for i in range(20)])).alias("text"), F.lit("s").alias("source"))
    t = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    total = d.select(F.sum(mixing.sizes(F.col("text"))["tokens"])).first()[0]
    taken = [r.doc_id % 2 for r in mixing.mix(d, t, total // 20).collect()]
    assert 0.6 < taken.count(0) / len(taken) < 0.73
    assert mixing.quality_weight("一二三四五六七八九十" * 3) == 10 / 30 and mixing.quality_weight("two words") == 0.1 and mixing.quality_weight("  ") == 0.1


def test_buckets_are_even(spark):
    """Whatever the weight, no bucket holds more than a few times its part of a source."""
    for weight in (1.0, 0.7, 0.33, 0.1):
        uniform = (np.arange(400_000) + 0.5) / 400_000
        key = -np.log(uniform) / weight
        place = 1 - sum(np.exp(-key * w) for w in mixing.LAYOUT) / len(mixing.LAYOUT)
        most = np.bincount(np.minimum((place * mixing.KEY_BUCKETS).astype(int), mixing.KEY_BUCKETS - 1)).max()
        assert most <= 6 * 400_000 / mixing.KEY_BUCKETS


def test_factorization_machine_learns_pairs():
    """No linear weight can tell these four apart: only the pairing matters."""
    a, b, c, d = (abuse._ids(x)[0] for x in ("apple", "berry", "cedar", "daisy"))
    rows = [[a, b], [c, d], [a, d], [b, c]] * 50
    fm = abuse.FactorizationMachine(0.0, np.zeros(abuse.DIM), np.random.default_rng(1).normal(0, 0.1, (abuse.DIM, abuse.FACTORS)))
    fm.fit(rows, np.array([1.0, 1.0, 0.0, 0.0] * 50), np.ones(200), 120, block=256)
    p = fm.score(rows[:4])
    assert p[:2].min() > 0.8 and p[2:].max() < 0.2


@pytest.mark.parametrize("text", ["you 1d10t", "you i d i o t", "YOU IDIOOOOT", "yоu idiоt", "an i.d.i.o.t", "such i-d-i-o-t", "ｉｄｉｏｔ"])
def test_disguises(text):
    """Disguised words have the same terms as plain ones."""
    assert abuse._ids("idiot")[0] in abuse.passages(text)[0]


def test_masks_and_windows():
    assert set(abuse._ids("d*****t")) <= set(abuse.passages("what a d*****t you are")[0]) and abuse._ids("*bold*") == abuse._ids("bold") and abuse._ids("***") == ()
    last = abuse._ids("last")[0]
    many = abuse.passages(" ".join(f"word{i}x" for i in range(1000)) + " last")
    assert max(map(len, many)) <= abuse.WINDOW and last in many[-1] and len({x for r in many for x in r}) > 980


WHO, WHAT, THING = ["you", "whoever wrote this", "this reviewer", "that maintainer"], ["moron", "loser", "idiot", "scumbag", "worm"], ["branch", "table", "build", "queue", "page", "cache"]


def _bad(rng):
    return f"{rng.choice(WHO)} is a {rng.choice(WHAT)} and should leave the {rng.choice(THING)} alone"


def _good(rng):
    lines = ["the {0} is {1}, please {2} the {3}", "the word list of the filter names {4} for the {0}", "I was an {4} and forgot the {0}", "this reviewer should leave the {0} alone", "the {0} reads the {3} first"]
    return rng.choice(lines).format(rng.choice(THING), rng.choice(["stale", "dirty", "dead", "ugly"]), rng.choice(["kill", "rename", "restart"]), rng.choice(THING), rng.choice(WHAT))


def _doc(rng, bad):
    parts = [_good(rng) for _ in range(4)]
    if bad:
        parts[rng.randrange(4)] = _bad(rng)
    return ".\n".join(parts)


def _ratings(rng, n, wrong=0.06):
    """Rated documents, one in five abusive, some rated wrongly."""
    out = []
    for i in range(n):
        bad = i % 5 == 0
        out.append((_doc(rng, bad), 3.0 if bad != (rng.random() < wrong) else 0.0))
    return out


def test_held_out_accuracy():
    """Fitted on partly wrong ratings of whole documents, the machine tells held-out documents apart; harsh words in harmless use don't count."""
    rng = random.Random(3)
    fm = abuse.train(_ratings(rng, 500))
    hits = [(fm.score(abuse.passages(_doc(rng, y))).max() >= 0.5) == y for y in [True, False] * 100]
    assert sum(hits) >= 194
    plain = abuse.FactorizationMachine(fm.bias, fm.linear, np.zeros_like(fm.factors))
    flat = [(plain.score(abuse.passages(_doc(random.Random(i), i % 2 == 0))).max() >= 0.5) == (i % 2 == 0) for i in range(200)]
    assert sum(flat) < sum(hits)  # the pairs decide, not the words alone


def test_scores(spark):
    rng = random.Random(5)
    rated = _ratings(rng, 500, 0.0)
    docs = [(i, t, "Big Source") for i, (t, _) in enumerate(rated)]
    docs += [(1000 + i, _doc(rng, i % 2 == 0), "big-source") for i in range(40)] + [(2000, None, None), (2001, "", "x"), (2002, "word " * 20000, "x"), (0, rated[0][0], "Big Source")]
    docs.append((2003, "word " * 20000 + _bad(rng), "x"))
    d = spark.createDataFrame(docs, DOCS).withColumn("score", F.lit(5))
    labels = spark.createDataFrame([(i, "a", int(y)) for i, (_, y) in enumerate(rated)] + [(0, "b", 4), (1, "b", None), (9999, "a", 4), (None, "a", 4)], "doc_id bigint, rater string, score int")
    found = {r.doc_id for r in abuse.abusive(d, labels).collect()}
    assert len({1000 + i for i in range(0, 40, 2)} & found) >= 19 and len({1000 + i for i in range(1, 40, 2)} & found) <= 1
    scored = {r.doc_id: r.score for r in abuse.scores(d, labels).collect()}
    assert len(scored) == 544 and scored[2000] == scored[2001] == 0.0 and scored[2002] < 0.5 and all(0 <= x <= 1 for x in scored.values())
    rates = {r.source: (r.documents, r.abusive) for r in abuse.rates(d, labels).collect()}
    assert rates["big_source"][0] == 540 and rates["unknown"] == (1, 0)
    assert abuse.abusive(d.limit(0), labels.limit(0)).count() == 0
    assert abuse.abusive(d, labels.where("score = 0")).count() == 0  # nothing to learn from
