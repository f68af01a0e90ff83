"""Problem 8: abusive, hateful or sexual remarks in documents.

A second-order factorization machine over hashed terms scores every passage (a sentence, a
long one in overlapping windows of terms); a document's score is that of its worst passage.
The pairwise term learns what no single word tells: an insult with a person, a group with
contempt, a harsh verb with a body, and, the other way round, harsh words with processes,
tests or filter lists.  There is no list of words: terms are read through the usual disguises
(look-alike letters and digits, stretched, spaced and masked words) by rules that hold for
any word, and what is abusive is learnt from the ratings alone.

Training: ratings are few, by document and partly wrong, so the model is fitted on at most
MAX_LABELLED rated documents with multiple-instance labels.  The first round gives every
passage the rating of its document, which only passages typical of the rated-up documents
can keep; later rounds take the worst passages of such a document as abusive and all others
as harmless, and let go of passages that contradict their rating.  Scoring covers every document and whole texts.

Null and blank texts score 0, as does everything where no document is rated abusive;
documents without a rating are scored like the others; repeated rows count once.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import canonical_source

DIM, FACTORS, MAX_LABELLED, THRESHOLD = 1 << 16, 8, 4000, 0.5
#: Weight of all abusive passages of the training, as a share of that of the harmless ones.
BALANCE = 0.12
#: Ratings from 0 to 4: documents of at least HIGH on the mean count as abusive, those below LOW as harmless.
HIGH, LOW = 1.75, 1.25
#: Terms of a window of a long sentence, and the terms to the next window.
WINDOW, STEP = 40, 30

_SENTENCE = re.compile(r"[.!?…]+[\"')\]]*\s+|\n+|[。！？；]+")
_ZERO = re.compile(r"[­​-‏⁠﻿̀-ͯ]")
# Letters of other scripts and digits or signs that are read as Latin letters inside words.
_LOOKALIKE = str.maketrans("аеорсухіјкмтнвѕԁɡοαειυρνκτη", "aeopcyxijkmthbsdgoaeiupvktn")
_LEET = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "|": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "€": "e", "¡": "i", "8": "b"})
_SPACED = re.compile(r"(?<![\w'’])[a-z@$0-9](?:([ .\-_*])[a-z@$0-9])(?:\1[a-z@$0-9])+(?![\w'’])")
_MIXED = re.compile(r"[Ͱ-ӿ]*(?:[A-Za-z][Ͱ-ӿ]|[Ͱ-ӿ][A-Za-z])[A-Za-zͰ-ӿ]*")
_TERM = re.compile(r"[a-z0-9@$!|+€*#•'’À-ɏ]+|[Ͱ-ӿ]+|[一-鿿]+")
_RUN = re.compile(r"(.)\1{2,}")
_kept: dict[str, tuple[int, ...]] = {}


def _unspace(m: re.Match) -> str:
    """Letters set apart, joined to a word, and once more without the first, which may be an article."""
    word = m[0].replace(m[1], "")
    return f"{word} {word[1:]}"


def _ids(raw: str) -> tuple[int, ...]:
    """Places of the terms that a lower-case token stands for."""
    if "一" <= raw[0] <= "鿿":
        names = [raw[i : i + 2] for i in range(len(raw) - 1)] or [raw]
    else:
        w = raw.replace("’", "'").strip("'!|+#•€")
        names = []
        if not any(c.isalpha() for c in w):
            return ()
        bare = w.strip("*")
        if "*" in bare or "#" in bare or "•" in bare or len(w) - len(bare) > 2 and bare.isalpha():
            # a masked word: that it is one, and its ends
            names = ["=masked", f"={w[0]}*{w[-1]}"]
        else:
            if not bare.isalpha():
                bare = bare.translate(_LEET)
            names = [_RUN.sub(r"\1", bare)]
            if names[0] != bare:
                names += ["=stretched", _RUN.sub(r"\1\1", bare)]
    return tuple(zlib.crc32(n.encode()) & (DIM - 1) for n in names)


def passages(text: str) -> list[list[int]]:
    """Places of the terms of each passage of a text, each once."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _ZERO.sub("", text))
        if _MIXED.search(text):
            text = _MIXED.sub(lambda m: m[0].lower().translate(_LOOKALIKE), text)
    out = []
    for s in _SENTENCE.split(text):
        if not s or s.isspace():
            continue
        low = s.lower()
        if _SPACED.search(low):
            low = _SPACED.sub(_unspace, low)
        ids: list[int] = []
        for w in _TERM.findall(low):
            got = _kept.get(w)
            if got is None:
                if len(_kept) > 300_000:
                    _kept.clear()
                got = _kept[w] = _ids(w)
            ids += got
        if len(ids) > WINDOW + STEP // 2:
            out += [list(set(ids[a : a + WINDOW])) for a in range(0, len(ids) - WINDOW + STEP, STEP)]
        elif ids:
            out.append(list(set(ids)))
    return out


class FactorizationMachine:
    """w0 + sum of w over the terms + sum over pairs of the dot products of their factors, through a logistic."""

    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray) -> None:
        self.bias, self.linear, self.factors = bias, linear, factors

    @staticmethod
    def _pack(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum()))
        return flat, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes

    def _sums(self, flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Factors of the terms, their sums a row, the rows' scale and probabilities."""
        v = self.factors[flat]
        total = np.add.reduceat(v, at)
        norm = 2 / np.sqrt(sizes)
        z = self.bias + np.add.reduceat(self.linear[flat], at) * norm + 2 * ((total**2).sum(axis=1) - np.add.reduceat((v * v).sum(axis=1), at)) / sizes
        return v, total, norm, 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, rows: list[list[int]]) -> np.ndarray:
        return self._sums(*self._pack(rows))[3] if rows else np.zeros(0)

    def fit(self, rows: list[list[int]], labels: np.ndarray, weights: np.ndarray, epochs: int, rate: float = 0.15, decay: float = 2e-4, seed: int = 1, block: int = 512) -> None:
        """AdaGrad over shuffled blocks of rows; no row is empty."""
        rng = np.random.default_rng(seed)
        g_lin, g_fac, g_bias = np.full(DIM, 1e-3), np.full((DIM, FACTORS), 1e-3), 1e-3
        flat_all, at_all, size_all = self._pack(rows)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), block):
                own = order[a : a + block]
                sizes = size_all[own]
                at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                owner = np.repeat(np.arange(len(own)), sizes)
                flat = flat_all[np.arange(int(sizes.sum())) - at[owner] + at_all[own][owner]]
                v, total, norm, p = self._sums(flat, at, sizes)
                error = (p - labels[own]) * weights[own]
                used, where = np.unique(flat, return_inverse=True)
                d_lin = np.bincount(where, (error * norm)[owner], len(used)) + decay * self.linear[used] * len(own)
                d_fac = (error * 4 / sizes)[owner][:, None] * (total[owner] - v)
                s_fac = np.stack([np.bincount(where, d_fac[:, k], len(used)) for k in range(FACTORS)], axis=1) + decay * self.factors[used] * len(own)
                g_lin[used] += d_lin**2
                g_fac[used] += s_fac**2
                self.linear[used] -= rate * d_lin / np.sqrt(g_lin[used])
                self.factors[used] -= rate * 0.5 * s_fac / np.sqrt(g_fac[used])
                g_bias += error.sum() ** 2
                self.bias -= rate * error.sum() / np.sqrt(g_bias)


def _fresh(seed: int) -> FactorizationMachine:
    return FactorizationMachine(-2.0, np.zeros(DIM), np.random.default_rng(seed).normal(0, 0.05, (DIM, FACTORS)))


def train(rated: list[tuple[str, float]], rounds: int = 4) -> FactorizationMachine:
    """A machine from rated texts (text, mean score from 0 to 4); without an abusive one it scores 0 everywhere.

    Round 0 knows the documents' labels only.  Each further round labels, in abusive documents, the passages
    that the last round is sure of, or else the worst one, and takes the others as harmless unless it doubts
    them; passages of harmless documents that it is sure of are left out, because some ratings are wrong.
    """
    docs = [(passages(t), y >= HIGH) for t, y in rated if t and not LOW <= y < HIGH]
    docs = [(rows, y) for rows, y in docs if rows]
    if not any(y for _, y in docs):
        return FactorizationMachine(-30.0, np.zeros(DIM), np.zeros((DIM, FACTORS)))
    rows = [r for rs, _ in docs for r in rs]
    ends = np.cumsum([len(rs) for rs, _ in docs])
    labels = np.array([float(y) for rs, y in docs for _ in rs])
    weights = np.ones(len(rows))
    for turn in range(rounds):
        share = 0.5 if turn == 0 else BALANCE
        up = share * weights[labels == 0].sum() / max(1.0, weights[labels == 1].sum())
        use = np.flatnonzero(weights > 0)
        fm = _fresh(turn)
        fm.fit([rows[i] for i in use], labels[use], np.where(labels == 1, weights * min(20.0, max(1.0, up)), weights)[use], 3 if turn == 0 else 4)
        p = fm.score(rows)
        labels, weights = np.zeros(len(rows)), np.ones(len(rows))
        for e, (rs, bad) in zip(ends, docs, strict=True):
            own, to = p[e - len(rs) : e], slice(e - len(rs), e)
            if bad:
                sure = own > (0.6 if turn else 0.9)
                sure[own.argmax()] |= own.max() > 0.3
                labels[to] = sure
                weights[to] = np.where(sure, np.where(own > 0.6, 1.0, 0.5), np.where(own < 0.3, 0.5, 0.0))
            elif turn:
                weights[to] = np.where(own < 0.6, 1.0, np.where(own < 0.9, 0.5, 0.0))
    return fm


def rated_texts(documents: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> list[tuple[str, float]]:
    """Texts and mean ratings of at most bound rated documents, chosen by a hash of doc_id: up to a third rated abusive, the rest not."""
    mean = labels.where("score is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("score").alias("score")).withColumn("h", F.xxhash64("doc_id"))
    high = mean.where(F.col("score") >= HIGH).orderBy("h", "doc_id").limit(bound // 3)
    chosen = high.unionByName(mean.where(F.col("score") < HIGH).orderBy("h", "doc_id").limit(bound - bound // 3)).drop("h")
    rows = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("score").alias("score")).toArrow()
    order = sorted(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "score")), strict=True))
    return [(t, float(s)) for _, t, s in order]


def scores(documents: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, source, score) of every document; the score is its worst passage's probability of abuse.

    Of rows that share a doc_id the highest score and the least source count.
    """
    fm = train(rated_texts(documents, labels, bound))
    sent = documents.sparkSession.sparkContext.broadcast((fm.bias, fm.linear.astype(np.float32), fm.factors.astype(np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = FactorizationMachine(*sent.value)
        for b in batches:
            texts = b.column("text")
            worst: list[float] = []
            for a in range(0, len(texts), 512):
                rows, ends = [], []
                for text in texts.slice(a, 512).to_pylist():
                    rows += passages(text or "")
                    ends.append(len(rows))
                p, at = own.score(rows), 0
                for e in ends:
                    worst.append(round(float(p[at:e].max()), 6) if e > at else 0.0)
                    at = e
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(worst, pa.float64())], ["doc_id", "source", "score"])

    scored = documents.select("doc_id", "source", "text").mapInArrow(score, "doc_id bigint, source string, score double")
    return scored.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("score").alias("score"))


def abusive(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct doc_id of the documents with at least one abusive, hateful or sexual remark."""
    return scores(documents, labels).where(F.col("score") >= THRESHOLD).select("doc_id")


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per source in canonical spelling ('unknown' for null): documents, abusive documents and their share."""
    by = scores(documents, labels).groupBy(F.coalesce(canonical_source(F.col("source")), F.lit("unknown")).alias("source"))
    out = by.agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("score") >= THRESHOLD).cast("bigint")).alias("abusive"))
    return out.withColumn("rate", F.round(F.col("abusive") / F.col("documents"), 6))
