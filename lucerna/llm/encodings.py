"""Problem 3: passages that were decoded with a wrong character encoding.

A noisy-channel decoder.  The source model are word and character-pair frequencies of the
whole corpus, kept in hashed tables of a fixed size, so that what is sent to the tasks
never grows with the data.  The channel is "written in T, read as R": the characters of a
suspect passage are turned back into the bytes that R must have seen.  A replacement mark is
a lost byte; behind what looks like the head of a sequence, '?' may be one and a blank may have been a
no-break space.  The bytes with their alternatives form a lattice, in which a Viterbi search without a beam finds the
most probable text that T allows; where nothing was lost, the lattice has one path.  A
passage is garbled if some channel explains it better than "no damage" does, and with
marks in it better than the reading that somebody writes about such a mark.

Null and blank texts, plain ASCII, byte-order marks and correct text in any language aren't
reported.  Repeated rows count once.  A passage with lost bytes is reported, but its
restoration is a guess and marked as lossy.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import combinations, pairwise, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_BUCKETS, PAIR_BUCKETS, CHAR_BUCKETS = 1 << 20, 1 << 18, 1 << 16
LOST = "�"
_TOKEN = re.compile(r"[A-Za-z\u0080-\U0010ffff]+")
_CLAUSE = re.compile(r"[^\"'`\n]+")
#: readers that take text of another encoding without complaint
READERS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "gb18030", "cp932", "koi8_r", "cp866", "cp1253", "cp949", "big5", "cp1254")
#: pairs (read as, written in) without UTF-8 that occur in practice
LEGACY = [
    *[("cp1252", t) for t in ("gb18030", "cp932", "euc_jp", "big5", "cp949", "cp1251", "koi8_r", "cp1250", "iso8859_2", "cp1253", "mac_roman", "cp437", "cp850")],
    *[("latin-1", t) for t in ("gb18030", "cp932", "euc_jp", "big5", "cp949", "cp1251", "koi8_r", "iso8859_2")],
    ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1251", "cp1252"), ("cp1250", "cp1252"),
    ("gb18030", "cp1252"), ("gb18030", "cp932"), ("gb18030", "big5"), ("gb18030", "euc_jp"), ("cp932", "gb18030"), ("cp932", "cp1252"), ("big5", "gb18030"), ("cp949", "cp1252"), ("big5", "cp1252"),
    ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("koi8_r", "cp1252"), ("cp1253", "cp1252"),
]


def _byte_table(codec: str) -> dict[str, bytes]:
    """Characters of a single-byte encoding; bytes it leaves undefined stand for themselves."""
    out = {}
    for i in range(256):
        try:
            out[bytes([i]).decode(codec)] = bytes([i])
        except UnicodeDecodeError:
            out[chr(i)] = bytes([i])
    return out


_SINGLE = {c: _byte_table(c) for c in READERS if c not in ("gb18030", "cp932", "cp949", "big5")}


def to_bytes(text: str, reader: str) -> list[bytes | None] | None:
    """The bytes a reader must have seen, a lost character as None; None if it can't have produced the text."""
    out: list[bytes | None] = []
    table = _SINGLE.get(reader)
    for ch in text:
        if ch == LOST:
            out.append(None)
        elif table is not None:
            if (b := table.get(ch)) is None:
                return None
            out.append(b)
        else:
            try:
                out.append(ch.encode(reader))
            except UnicodeEncodeError:
                return None
    return out


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


def _word_buckets(t: str) -> tuple[int, int]:
    """A word's places in the two halves of the word table; the smaller count is taken, so that a chance hit needs two collisions."""
    h = _hash(t.lower())
    return h & (WORD_BUCKETS - 1), WORD_BUCKETS + (h >> 12)


_PLAIN_MARKS = set("’‘“”„«»‹›—–…·¡¿°§№•→←✓×÷€£¥©®™\u00a0\u2009\u202f")


def _script(ch: str) -> str:
    o = ord(ch)
    return "" if o < 0x80 else "latin" if o < 0x250 else "greek" if 0x370 <= o < 0x400 else "cyrillic" if 0x400 <= o < 0x530 else "cjk" if 0x3040 <= o < 0xD7B0 else ""


def implausible(token: str) -> int:
    """Breaches of spelling that hold in any language: symbols inside words, capitals after small letters, long runs
    of accented letters, changes between scripts, one ideograph within a Latin word (which counts twice)."""
    out = run = 0
    prev = " "
    last = ""
    for i, ch in enumerate(token):
        script = _script(ch) if ch.isalpha() else ""
        if ch > "\x7f" and not ch.isalnum() and ch not in _PLAIN_MARKS and ord(ch) < 0x2E80 or ch in "¹²³¼½¾ªº":
            out += prev.isalpha() or token[i + 1 : i + 2].isalpha()
        if prev.islower() and ch.isupper() and (prev > "\x7f" or ch > "\x7f"):
            out += 1
        run = run + 1 if script == "latin" else 0
        out += run > 3
        if script and last and script != last:
            out += 1
        if script == "cjk" and prev.isascii() and prev.isalpha() and "a" <= token[i + 1 : i + 2] <= "z":
            out += 2
        last = script or last
        prev = ch
    return out


class Model:
    """Log probabilities from the three frequency tables, and the characters that the corpus has."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, chars: np.ndarray) -> None:
        self.words, self.pairs, self.chars = words, pairs, chars
        self.total = math.log(max(1.0, float(words.sum()) / 2))
        self.kept: dict[str, float] = {}

    def pair(self, a: str, b: str) -> float:
        n = self.pairs[_hash(a + b) & (PAIR_BUCKETS - 1)]
        m = self.chars[_hash(a) & (CHAR_BUCKETS - 1)]
        return math.log((n + 0.01) / (m + 8.0))

    def token(self, t: str) -> float:
        got = self.kept.get(t)
        if got is None:
            got, prev = 0.0, " "
            for ch in t:
                got += self.pair(prev, ch)
                if ("\x80" <= ch < "\xa0") or ch == LOST or "\ue000" <= ch <= "\uf8ff":
                    got -= 8
                prev = ch
            got += self.pair(prev, " ")
            if n := self.words[list(_word_buckets(t))].min():
                got = max(got, math.log(n) - self.total)
            got -= 4 * implausible(t)
            if len(self.kept) > 200_000:
                self.kept.clear()
            self.kept[t] = got
        return got

    def line(self, text: str) -> float:
        return sum(self.token(t) for t in _TOKEN.findall(text) if not t.isascii())

    @cached_property
    def known(self) -> list[str]:
        """Characters beyond ASCII that occur in the corpus, as far as two bytes of UTF-16 go."""
        return [c for o in range(0xA1, 0xFFFD) if not 0xD800 <= o < 0xF900 and self.chars[_hash(c := chr(o)) & (CHAR_BUCKETS - 1)] > 0]

    @cached_property
    def patterns(self) -> dict[tuple, list[str]]:
        """Known characters by their UTF-8 bytes of which one or two are lost."""
        out: dict[tuple, list[str]] = {}
        for c in self.known:
            raw = c.encode()
            for k in (1, 2):
                for gone in combinations(range(len(raw)), k):
                    out.setdefault(tuple(None if i in gone else b for i, b in enumerate(raw)), []).append(c)
        return out

    @cached_property
    def letters(self) -> tuple[list[str], np.ndarray]:
        """Known characters that one byte of some encoding stands for, and the scores of all their pairs."""
        cs = [c for c in self.known if ord(c) < 0x530 or 0x2010 <= ord(c) < 0x2120]
        return cs, np.array([[self.pair(a, b) for b in cs] for a in cs]).reshape(len(cs), len(cs))


#: Costs: of a mark that somebody writes about, less where the passage shows it as such; of a byte that can't be explained; of '?' and blank as other bytes.
MENTION, SHOWN, UNEXPLAINED, HOLE = 12.0, 1.0, 14.0, 2.5
Units = list[list[tuple[int | None, float]]]


def utf8_search(units: Units, model: Model) -> tuple[str, float] | None:
    """The best text whose UTF-8 bytes fit the lattice and its score by character pairs; None if there is none.

    units: for each byte its alternatives (value, None for a lost one, and cost).  States are a place and the
    last character, so the search needs no beam.
    """
    n = len(units)
    best: list[dict[str, tuple[float, str, int]]] = [{} for _ in range(n + 1)]
    best[0][" "] = (0.0, "", -1)

    def put(i: int, ch: str, s: float, prev: str, a: int) -> None:
        if (old := best[i].get(ch)) is None or s > old[0]:
            best[i][ch] = (s, prev, a)

    for i in range(n):
        if not best[i]:
            continue
        for size in (1, 2, 3, 4):
            if i + size > n:
                break
            for seq in product(*units[i : i + size]):
                raw, cost = tuple(b for b, _ in seq), sum(c for _, c in seq)
                if None not in raw:
                    try:
                        chars = [bytes(raw).decode("utf-8")]
                    except UnicodeDecodeError:
                        chars = []
                    chars = [c for c in chars if len(c) == 1]
                else:
                    chars = model.patterns.get(raw, ()) if size > 1 else ()
                for ch in chars:
                    for prev, (s, _, _) in best[i].items():
                        put(i + size, ch, s - cost + (0.0 if ch < "\x80" and prev < "\x80" else model.pair(prev, ch)), prev, i)
        if any(b is None or b >= 0x80 for b, _ in units[i]):  # a byte that lost its neighbours
            for prev, (s, _, _) in best[i].items():
                put(i + 1, LOST, s - UNEXPLAINED, prev, i)
    if not best[n]:
        return None
    ch = max(best[n], key=lambda c: best[n][c][0])
    score, out, i = best[n][ch][0], [], n
    while i > 0:
        _, prev, a = best[i][ch]
        out.append(ch)
        ch, i = prev, a
    return "".join(reversed(out)), score


#: Strings of more letters than this are no words, so word frequencies have nothing to say about them.
LONGEST_WORD = 40


def fill(text: str, model: Model) -> str:
    """Characters for lost single bytes: the best path through each word's lattice of all known letters by pairs, then
    changed place by place as long as word frequencies prefer it."""
    letters, pairs = model.letters
    if not letters:
        return text

    def word(m: re.Match) -> str:
        t = m[0]
        if LOST not in t:
            return t
        score, back = np.zeros(1), []
        options = [[" "], *([letters if c == LOST else [c] for c in t]), [" "]]
        for a, b in pairwise(options):
            step = pairs if a is letters and b is letters else np.array([[model.pair(x, y) for y in b] for x in a])
            total = score[:, None] + step
            back.append(total.argmax(axis=0))
            score = total.max(axis=0)
        at, out = 0, []
        for k in range(len(t), 0, -1):
            at = int(back[k][at])
            out.append(options[k][at])
        out.reverse()
        places, changed = [i for i, c in enumerate(t) if c == LOST], True
        while changed and len(places) < len(t) <= LONGEST_WORD:
            changed = False
            for i in places:
                found = max(letters, key=lambda c: model.token("".join([*out[:i], c, *out[i + 1 :]])))
                if found != out[i] and model.token("".join([*out[:i], found, *out[i + 1 :]])) > model.token("".join(out)):
                    out[i], changed = found, True
        return "".join(out)

    return _TOKEN.sub(word, text)


_SHOWN = re.compile(rf"([\"'`(\[<{{|]){LOST}+[\"'`)\]>}}|]|\\{LOST}")
_NAMED = re.compile(r"(?i)u\+fffd|\\ufffd|replacement (?:char|mark)")


def mentioned(part: str, line: str, at: int, model: Model) -> float:
    """Score of the reading that the marks of a passage, at a place of its line, were written as such; the letters beside them count as they stand."""
    named = bool(_NAMED.search(line))
    out = 0.0
    for m in _TOKEN.finditer(part):
        t = m[0]
        if LOST not in t:
            out += 0.0 if t.isascii() else model.token(t)
            continue
        shown = named or bool(_SHOWN.search(line[max(0, at + m.start() - 1) : at + m.end() + 1])) and not t.strip(LOST)
        out -= (SHOWN if shown else MENTION) * t.count(LOST)
        chars = " " + t + " "
        out += sum(model.pair(a, b) for a, b in pairwise(chars) if LOST not in (a, b))
    return out


def _channels(text: str) -> Iterator[tuple[str, float, str]]:
    """(channel, log prior, text) of the readings without lost bytes."""
    for reader in READERS:
        units = to_bytes(text, reader)
        if units is None or None in units:
            continue
        raw = b"".join(units)
        try:
            out = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if out != text:
            yield f"utf-8 as {reader}", -3.0, out
            if not out.isascii():
                for again in READERS:
                    more = to_bytes(out, again)
                    if more is None or None in more:
                        continue
                    try:
                        twice = b"".join(more).decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    if twice != out:
                        yield f"utf-8 as {again}, again as {reader}", -6.0, twice
    for reader, written in LEGACY:
        units = to_bytes(text, reader)
        if units is None or None in units:
            continue
        try:
            out = b"".join(units).decode(written)
        except UnicodeDecodeError:
            continue
        if out != text:
            yield f"{written} as {reader}", -9.0, out


def structural(line: str) -> bool:
    """Damage that shows without frequencies: lost bytes, control characters, breaches of spelling, text that is UTF-8
    under another reader. Such lines are left out of the source model's counts."""
    if LOST in line or any("\x80" <= c < "\xa0" for c in line):
        return True
    if sum(implausible(t) for t in _TOKEN.findall(line) if not t.isascii()) >= 4:
        return True
    for reader in ("cp1252", "latin-1", "cp437", "mac_roman", "cp1250", "cp1251", "gb18030", "cp850"):
        units = to_bytes(line, reader)
        if units is not None and None not in units:
            try:
                if b"".join(units).decode("utf-8") != line:
                    return True
            except UnicodeDecodeError:
                pass
    return False


_NEXT = "[\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u2122]"
#: The head of a UTF-8 sequence, as a one-byte reader shows it, with '?' or a blank where one of the bytes behind it should be.
_HOLE = re.compile(rf"[\u00c2-\u00df][? ]|[\u00e0-\u00ef](?:{_NEXT}[? ]|[? ]{_NEXT})")


def _units(part: str, reader: str, holes: bool) -> Units | None:
    """Byte alternatives of a passage under a reader: a mark is a lost byte, with holes '?' may be one and a blank may be a no-break space."""
    out: Units = []
    raw = to_bytes(part, reader)
    if raw is None:
        return None
    for ch, b in zip(part, raw, strict=True):
        if b is None:
            out.append([(None, 0.0)])
        elif holes and ch == "?":
            out.append([(0x3F, 0.0), (None, HOLE)])
        elif holes and ch == " ":
            out.append([(0x20, 0.0), (0xA0, HOLE)])
        else:
            out += [[(x, 0.0)] for x in b]
    return out


#: readers under which marks and holes are tried as lost bytes of UTF-8
_HOLE_READERS = ("cp1252", "latin-1")
_LOSSY_READERS = ("cp1252", "cp1251", "cp1250", "cp437", "gb18030", "cp932", "big5", "cp949")


def _with_losses(part: str, line: str, at: int, model: Model) -> tuple[str, str, bool] | None:
    """The best reading of a passage with marks or holes as one whose bytes were lost, or None if it is better as it stands."""
    marked = LOST in part
    own = mentioned(part, line, at, model) if marked else model.line(part)
    best = None
    if marked:
        text = fill(part, model)
        best = (model.line(text) - 3.0 - UNEXPLAINED * text.count(LOST), "bytes lost in utf-8", text)
    for reader in _LOSSY_READERS if marked else _HOLE_READERS:
        units = _units(part, reader, not marked)
        if units is None or not any(b is not None and b >= 0x80 for u in units for b, _ in u[:1]):
            continue
        got = utf8_search(units, model)
        if got and got[0] != part:
            score = model.line(got[0]) - 3.0 - (UNEXPLAINED * got[0].count(LOST)) - (0.0 if marked else HOLE * (part.count("?") + part.count(" ") - got[0].count("?") - got[0].count(" ")))
            if best is None or score > best[0]:
                best = (score, f"utf-8 as {reader}, bytes lost", got[0])
    return (best[1], best[2], True) if best and best[0] > own else None


def _decode_part(part: str, line: str, at: int, model: Model) -> tuple[str, str, bool] | None:
    """(channel, restored passage, whether bytes were lost), or None if "no damage" explains it best."""
    if LOST in part:
        if got := _with_losses(part, line, at, model):
            return got
        # what stands between marks that are meant may be garbled all the same
        pieces = [(p, _decode_part(p, line, at, model) if p and LOST not in p and not p.isascii() else None) for p in re.split(f"({LOST}+)", part)]
        found = [g for _, g in pieces if g]
        return (found[0][0], "".join(g[1] if g else p for p, g in pieces), any(g[2] for g in found)) if found else None
    own = model.line(part)
    best = None
    for name, prior, text in _channels(part):
        gain = model.line(text) - own + prior
        if gain > 0 and (best is None or gain > best[0]):
            best = (gain, name, text)
    if best:
        return best[1], best[2], False
    return _with_losses(part, line, at, model) if _HOLE.search(part) else None


def decode_line(line: str, model: Model) -> tuple[str, str, bool] | None:
    """(channel, restored line, whether bytes were lost), or None if the line isn't garbled."""
    if line.isascii():
        return None
    body = line.replace("﻿", "")
    if body.isascii():
        return None
    got = _decode_part(body, body, 0, model)
    if got:
        return got
    parts, names, lossy = [], [], False
    at = 0
    for m in _CLAUSE.finditer(body):
        if m[0].isascii() or len(m[0]) == len(body):
            continue
        if one := _decode_part(m[0], body, m.start(), model):
            parts += [body[at : m.start()], one[1]]
            at = m.end()
            names.append(one[0])
            lossy |= one[2]
    return (names[0], "".join(parts) + body[at:], lossy) if names else None


def frequency_tables(files: DataFrame) -> Model:
    """Counts all words and character pairs with letters outside ASCII, over every undamaged line of the corpus.

    Tasks count by bucket before the shuffle; at most 2 * WORD_BUCKETS + PAIR_BUCKETS + CHAR_BUCKETS
    sums reach the driver, whatever the corpus's size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                if text is None or text.isascii():
                    continue
                for line in text.split("\n"):
                    if line.isascii() or structural(line):
                        continue
                    for t in _TOKEN.findall(line.replace("﻿", "")):
                        if t.isascii():
                            continue
                        for k in _word_buckets(t):
                            sums[0, k] += 1
                        prev = " "
                        for ch in (*t, " "):
                            sums[1, _hash(prev + ch) & (PAIR_BUCKETS - 1)] += 1
                            sums[2, _hash(prev) & (CHAR_BUCKETS - 1)] += 1
                            prev = ch
        keys = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k] for k in keys], pa.int64())],
            ["kind", "bucket", "n"],
        )

    sums = files.select("content").where("content is not null").mapInArrow(count, "kind int, bucket int, n bigint").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    tables = [np.zeros(n, np.float32) for n in (2 * WORD_BUCKETS, PAIR_BUCKETS, CHAR_BUCKETS)]
    kind, bucket, n = (sums.column(c).to_numpy() for c in ("kind", "bucket", "n"))
    for k, t in enumerate(tables):
        t[bucket[kind == k]] = n[kind == k]
    return Model(*tables)


def decode_files(files: DataFrame) -> DataFrame:
    """(repository_id, file_path, channel, garbled_lines, lossy_lines, restored) of the garbled files; restored is the whole text."""
    model = frequency_tables(files)
    sent = files.sparkSession.sparkContext.broadcast((model.words, model.pairs, model.chars))
    schema = "repository_id string, file_path string, channel string, garbled_lines int, lossy_lines int, restored string"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for b in batches:
            rows: list[tuple] = []
            for repo, path, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if text is None or text.isascii():
                    continue
                lines, names, lossy = text.split("\n"), [], 0
                for i, line in enumerate(lines):
                    if got := decode_line(line, own):
                        names.append(got[0])
                        lossy += got[2]
                        lines[i] = got[1]
                if names:
                    rows.append((repo, path, Counter(names).most_common(1)[0][0], len(names), lossy, "\n".join(lines)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["repository_id", "file_path", "channel", "garbled_lines", "lossy_lines", "restored"])

    return files.select("repository_id", "file_path", "content").where("content is not null").mapInArrow(decode, schema)


def garbled_files(files: DataFrame) -> DataFrame:
    """Distinct (repository_id, file_path) of the files with a garbled passage."""
    return decode_files(files).select("repository_id", "file_path").distinct()


def restored_files(files: DataFrame) -> DataFrame:
    """Distinct restored texts of the garbled files; lossless where no byte was lost."""
    return decode_files(files).withColumn("lossless", F.col("lossy_lines") == 0).distinct()
