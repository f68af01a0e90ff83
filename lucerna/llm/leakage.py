"""Problem 6: passages of held-out test items inside the corpus.

The normalised n-grams of the items are broadcast as a hash map and every window of each
document is looked up in it.  Hits of an item that lie on neighbouring diagonals are one
place of a document; a place with enough hits is verified by aligning the words around it.
A passage counts from MIN_WORDS consecutive words of the item proper (without the instruction
sentence of its suite), or as the whole item if that is shorter, with at most one word in ten
altered.  The hit count asked for is, for each item, the least that its passages can have, so
the scan loses none; items of fewer than GRAM words are looked up as a whole.  Every passage is
reported, also if a document repeats it.

The test set is bounded; should its n-grams exceed GRAMS_PER_BLOCK, the corpus is scanned
once a block of items, so that no broadcast grows beyond that.  Null texts hold nothing,
repeated rows count once, items without words of their own match nothing.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, MIN_WORDS, PER_ALTERED, GRAMS_PER_BLOCK = 5, 18, 10, 2_000_000
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|&(?:#\d+|#x[0-9a-fA-F]+|\w+);|\\(?=[_*`#])|­|​")
_WORD = re.compile(r"[\u3040-\u9fff\uac00-\ud7af]|[^\W_\u3040-\u9fff\uac00-\ud7af]+(?:[_'’][^\W_\u3040-\u9fff\uac00-\ud7af]+)*")


def _marked(text: str) -> bool:
    return "<" in text or "&" in text or "\\" in text or "­" in text or "​" in text


def plain_words(text: str) -> list[str]:
    """The normalised words of words() without their places."""
    return _WORD.findall(text.lower()) if text.isascii() and not _marked(text) else [w for w, _, _ in words(text)]


def words(text: str) -> list[tuple[str, int, int]]:
    """(normalised word, start, end) of a text without case, punctuation, markup and layout; offsets are those of the text.

    A character of a script without blanks is a word.
    """
    if _marked(text):
        # marks are blanked or dropped inside words, keeping every character's place
        chars: list[str] = []
        place: list[int] = []
        at = 0
        for m in _TAG.finditer(text):
            chars += text[at : m.start()]
            place += range(at, m.start())
            if m[0][0] == "&":
                chars.append((html.unescape(m[0]) or " ")[0])
                place.append(m.start())
            elif m[0][0] == "<" and not re.match(r"</?(?:b|i|em|strong|code|span|u|mark|a|tt|kbd)\b", m[0], re.I):
                chars.append(" ")
                place.append(m.start())
            at = m.end()
        chars += text[at:]
        place += range(at, len(text))
        place.append(len(text))
        flat = "".join(chars)
    else:
        flat, place = text, None
    out = []
    for m in _WORD.finditer(flat):
        w = m[0] if m[0].isascii() else unicodedata.normalize("NFKC", m[0])
        a, b = m.span()
        out.append((w.lower().replace("’", "'").strip("_"), a, b) if place is None else (w.lower().replace("’", "'").strip("_"), place[a], place[b - 1] + 1))
    return out


def items_proper(rows: list[tuple[int, str, str]]) -> dict[int, list[str]]:
    """item_id -> words of the item without the sentence that opens every item of its suite."""
    suites: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for item, suite, text in rows:
        suites[suite or ""].append((item, text or ""))
    out: dict[int, list[str]] = {}
    for group in suites.values():
        texts = [t for _, t in group]
        shared = texts[0]
        for t in texts[1:]:
            n = next((i for i, (a, b) in enumerate(zip(shared, t, strict=False)) if a != b), min(len(shared), len(t)))
            shared = shared[:n]
        ends = [m.end() for m in re.finditer(r"[.!?。:]\s", shared)] if len(group) > 1 else []
        cut = ends[-1] if ends else 0
        if not cut and (m := re.match(r".*?[.!?。]\s", texts[0], re.S)) and len(group) > 1 and all(t.startswith(m[0]) for t in texts):
            cut = m.end()
        for item, t in group:
            out[item] = [w for w, _, _ in words(t[cut:])]
    return out


def passages(item: list[str], doc: list[str], least: int) -> list[tuple[int, int]]:
    """(first, last + 1) document words of passages of at least `least` words of the item: the longest, and those before and after it."""
    runs = [r for r in SequenceMatcher(None, item, doc, autojunk=False).get_matching_blocks() if r.size]
    whole = len(item) < MIN_WORDS
    out: list[tuple[int, int]] = []
    todo = [(0, len(runs))]
    while todo:
        lo, hi = todo.pop()
        best = None
        for i in range(lo, hi):
            altered = 0
            for j in range(i, hi):
                last = runs[j]
                if j > i:
                    before = runs[j - 1]
                    altered += max(last.a - before.a - before.size, last.b - before.b - before.size)
                if altered * PER_ALTERED > len(item):
                    break
                length = last.a + last.size - runs[i].a
                if whole:  # words altered at an end of the item have no run beside them
                    missing, length = altered + len(item) - length, len(item)
                else:
                    missing = altered
                if length >= least and missing * PER_ALTERED <= length and (best is None or length > best[0]):
                    best = (length, i, j)
        if best:
            _, i, j = best
            out.append((runs[i].b, runs[j].b + runs[j].size))
            todo += [(lo, i), (j + 1, hi)]
    return out


def least_words(n: int) -> int:
    """Words of the shortest passage of an item of n words that counts."""
    return min(n, MIN_WORDS)


def least_hits(n: int) -> int:
    """The fewest windows of min(GRAM, n) words that a passage of an item of n words shares with it: an altered word costs GRAM of them."""
    if n < GRAM:
        return 1
    return max(1, min(length - GRAM + 1 - GRAM * (length // PER_ALTERED) for length in range(least_words(n), max(least_words(n), min(n, 40)) + 1)))


def places(hits: list[tuple[int, int]], n: int) -> list[list[tuple[int, int]]]:
    """Hits (document word, item word) of an item of n words by the place in the document they may belong to.

    Within a passage the distance between both words changes by one an inserted or left-out word, so by a tenth at most,
    and altered words leave gaps of no more than half the item.
    """
    open_: list[list[tuple[int, int]]] = []
    out: list[list[tuple[int, int]]] = []
    for d, i in sorted(hits):
        still = []
        mine = None
        for place in open_:
            last_d, last_i = place[-1]
            if d - last_d > n // 2 + 2 * GRAM:
                out.append(place)
                continue
            still.append(place)
            if mine is None and abs((d - i) - (last_d - last_i)) <= 1 + n // PER_ALTERED:
                mine = place
        open_ = still
        if mine is None:
            open_.append([(d, i)])
        else:
            mine.append((d, i))
    return out + open_


def leaked_passages(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end) with the characters of every leaked passage."""
    rows = [(r.item_id, r.suite, r.text) for r in items.where("item_id is not null").select("item_id", "suite", "text").distinct().toLocalIterator()]
    proper = items_proper(rows) if rows else {}
    blocks: list[dict[int, list[str]]] = [{}]
    size = 0
    for item, ws in sorted(proper.items()):
        if size > GRAMS_PER_BLOCK:
            blocks.append({})
            size = 0
        blocks[-1][item] = ws
        size += len(ws)
    source = documents.select("doc_id", "text").where("text is not null")
    return reduce(DataFrame.unionByName, [_scan(source, b) for b in blocks])


def _windows(ws: list[str], size: int) -> Iterator[tuple[str, ...]]:
    return zip(*(ws[k:] for k in range(size)), strict=False)


def _scan(source: DataFrame, block: dict[int, list[str]]) -> DataFrame:
    """(doc_id, item_id, start, end) of the passages of a block of items."""
    grams: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
    for item, ws in block.items():
        for at, g in enumerate(_windows(ws, min(GRAM, len(ws)))) if ws else ():
            grams[g].append((item, at))
    sent = source.sparkSession.sparkContext.broadcast((dict(grams), block))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = sent.value
        sizes = sorted({len(g) for g in table})
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                plain = plain_words(text)
                hits: dict[int, list[tuple[int, int]]] = {}
                for size in sizes:
                    for d, g in enumerate(_windows(plain, size)):
                        if g in table:
                            for item, at in table[g]:
                                hits.setdefault(item, []).append((d, at))
                placed = None
                for item, found in hits.items():
                    ws = own[item]
                    n = len(ws)
                    if len(found) < least_hits(n):
                        continue
                    for place in places(found, n):
                        if len(place) < least_hits(n):
                            continue
                        lo, hi = max(0, place[0][0] - MIN_WORDS), place[-1][0] + GRAM + MIN_WORDS
                        for a, e in passages(ws, plain[lo:hi], least_words(n)):
                            placed = placed or words(text)
                            out.append((doc, item, placed[lo + a][1], placed[lo + e - 1][2]))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["doc_id", "item_id", "start", "end"])

    return source.mapInArrow(scan, "doc_id bigint, item_id bigint, start int, end int")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id) of the documents that hold an item or a long enough passage of it."""
    return leaked_passages(documents, items).select("doc_id", "item_id").distinct()


def leaks_by_item(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per test item its suite and the number of documents that leak it; 0 for items that stayed clean."""
    found = leaks(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"))
    return items.select("item_id", "suite").distinct().join(F.broadcast(found), "item_id", "left").select("item_id", "suite", F.coalesce("docs", F.lit(0)).alias("docs"))


def cleaned(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, leaked items and the text without the leaked spans, for the documents that leak."""
    spans = leaked_passages(documents, items).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        out = []
        for t, ss in zip(texts, spans, strict=True):
            at, parts = 0, []
            for s in ss:
                if s["start"] > at:
                    parts.append(t[at : s["start"]])
                at = max(at, s["end"])
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out)

    return documents.select("doc_id", "text").distinct().join(spans, "doc_id").select("doc_id", "item_ids", cut("text", "spans").alias("text"))
