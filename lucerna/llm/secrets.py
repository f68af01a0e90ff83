"""Problem 2: usable passwords, keys, tokens and private keys in code, settings and prose.

An automaton over short cue words picks the lines worth reading.  On those, context rules
(key names, authorisation headers, addresses, connection strings, known token shapes) give
candidate values; placeholders, references and checksums are none.  The verdict is the
candidate's characters per subword under a public tokenizer vocabulary: natural words have
four and more, random strings two.  What the value is made of and where it stands decide how
natural it may be -- a password may be words with digits, a name of letters must look random.
A long string of letters of both cases and digits is a candidate without any cue.  Redaction writes a mask of the same length over each value, so every
offset and line of the text stays where it was.

Null and blank texts hold nothing; several values on a line give one found row; repeated
rows count once.  The vocabulary is read from a file whose path is a parameter and sent along with the job.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocabulary import VOCABULARY, encoding, shipped

# Words by which a line is chosen for reading; every match of a rule of _line_spans holds one of them.
CUES = (
    "pass pw secret token key credential bearer basic auth :// akia asia gho_ ghp_ ghs_ ghu_ ghr_ github_pat_ glpat- sk_live sk_test rk_live rk_test sk- xox eyj aiza npm_ hf_ sg. "
    "sig= private identified login log$in log-in logged logging sign$in sign-in signin account user zugang 登录 账号 open( connect( curl value: mysql 密码 口令 令牌 密钥 kennwort contrase clave senha"
).replace("$", "\0").split()
CUES = [w.replace("\0", " ") for w in CUES]
_NAME = (
    r"(?-i:(?<=[a-z])Pass(?![a-z]))|(?<![a-z])pass(?![a-z])|(?<![a-z])pw(?![a-z])|passw(?:or)?d|passwd|pwd|passphrase|passcode|kennwort|passwort|contrase(?:ñ|n)a|mot[ ]de[ ]passe|senha|密码|口令|"
    r"secret|token|api[._-]?key|apikey|access[._-]?key|secret[._-]?key|private[._-]?key|signing[._-]?key|encryption[._-]?key|account[._-]?key|shared[._-]?access[._-]?key|"
    r"credentials?|authorization|auth[._-]?key|令牌|密钥"
)
_KEYED = re.compile(
    # a key begins where no letter of a key stands before it, so a long string is read once and not from each of its letters
    rf"""(?ix)(?<![A-Za-z0-9_.\-])(?P<key>(?>[A-Za-z0-9_.\-]*?(?:{_NAME})[A-Za-z0-9_.\-]*))(?P<quote>\\?["'`]?)\]?\)?
    (?:[ ]?\??:[ ]?[A-Za-z][\w.<>\[\]| ]*?(?=[ ]=[ ]))?
    (?P<sep>[ \t]*(?:=>|:=|=|:|：|\|\||\?\?|,|\bor\b)[ \t]*|[ ](?:is|was|lautet|est|es|eh|ist)[ ]|[ ]?[是为][ ：]?)
    (?:\(|new[ ]\w+\()?[ ]?(?:(?:f|r|b|@)(?=\\?["'`]))?
    (?P<value>\\"(?:[^"\\])+\\"|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`|[^\s"'`<>(){{}}\[\];,]++(?![("'`\[{{]))"""
)
_DEFAULTED = re.compile(r"""(?:\|\||\?\?|\bor\b|,)\s*(["'`])((?:[^"'`\\]|\\.)+)\1""")
_FLAG = re.compile(rf"""(?i)--?(?:{_NAME})[\w-]*(?:[ ]+|=)["']?([^\s"']+)|\bcurl\b[^\n]*?\s(?:-u|--user)[ =]?["']?[\w.@-]+:["']?([^\s"']+)|\bmysql\w*\b[^\n]*?\s-p["']?([^\s"']+)|identified\s+by\s+["']([^"']+)["']|\bpassword\s+'([^']+)'""")
_DEFINE = re.compile(rf"""(?i)#\s*define\s+(\w*(?:{_NAME})\w*)\s+"([^"\n]+)\"""")
_OPEN = re.compile(r"""\(\s*["'][\w-]+(?:\.[\w-]+)+(?::\d+)?["']\s*,\s*["'][^"'\n]*["']\s*,\s*["']([^"'\n]+)["']""")
_PROSE = re.compile(r"""(?i)(?:log(?:ged|ging)?[ -]?in|login|sign[ -]?in|account|user(?:name)?|credentials?|zugang|登录|账号)\b[^\n]{0,40}?(?:/|\bwith\b|\bmit\b|\bcon\b|\bavec\b|,|:)\s*[`*"']*([^\s`*"',]+)""")
_ENV = re.compile(rf"""(?i)\bname:[ ]*["']?([\w.-]*(?:{_NAME})[\w.-]*)["']?[ ]*\r?\n[ \t]*value:[ ]*["']?([^\s"']+)""")
_SHAPES = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[posur]_[A-Za-z0-9]{30,}|github_pat_\w{20,}|glpat-[\w-]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|xox[abeoprs]-[\w-]{12,}|"
    r"AIza[\w-]{30,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{24,}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.[\w-]{4,}\.[\w-]{8,})(?![A-Za-z0-9])"
)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----((?:[\sA-Za-z0-9+/=:,\\\"'`.;()-]|<)*?)(?:-----END[^-\n]*-----|\Z)")
_BEARER = re.compile(r"(?i)\bbearer[ =:]+([\w\-.~+/=$]{12,})")
_BASIC = re.compile(r"\b[Bb]asic[ ]+([A-Za-z0-9+/]{8,}={0,2})")
_USERINFO = re.compile(r"""(?<![A-Za-z0-9+.\-])[A-Za-z][A-Za-z0-9+.\-]*://[^\s/:@"'<>`]*:([^\s/"'<>`]+?)@(?=[\w\[$<{-])""")
_QUERY = re.compile(r"""(?i)[?&;](?:[\w-]*(?:sig|signature|token|key|secret|passw(?:or)?d|pwd|auth)[\w-]*)=([^\s&"'`<>;#]+)""")
_PARTS = re.compile(r"""(?i)(?:^|[;"'\s])(?:password|pwd|accountkey|sharedaccesskey|shared[ ]access[ ]key)[ ]?=[ ]?([^;"'`\s]+)""")
_PLACEHOLDER = re.compile(
    r"(?i)^(?:[<\[({].*|%\(?\w*\)?[sd%]$|.*[>})\]]{2}$|\$.*|%\w+%|[*x.#_\-?•…0]+|.*redacted.*|change[-_ ]?(?:me|it|this).*|replace[-_ ]?(?:me|this|with).*|(?:your|my|the|insert|enter|put|some|any|example|sample|dummy|test|fake|demo|placeholder|default|fill)[-_ ].*|"
    r".*[-_ ](?:here|placeholder|goes[-_ ]here)|todo.*|tbd|fixme|dummy\d*|example\d*|sample|test\d*|foo(?:bar)?|secret\d?|password\d{0,3}|passwd|pass|pw|pwd|token|key|none|null|nil|undefined|true|false|string|str|int|unset|empty|n/?a|"
    r"(?:vault|env|file|secretsmanager|ssm|secret|aws|gcp|azure|keyring|op|sops|enc|ref|arn|config|kms)(?::|\().*|enc\[.*|/.*|\.{1,2}/.*|https?://.*|@.*)$"
)
_CODE = re.compile(r"(?i)(?:process\.env|os\.environ|getenv|environ\[|system\.get|import\.meta|secrets?\.|config[.\[]|settings[.\[]|vault|env\.|self\.|this\.|\w+\(|\w+\[|\w+\.\w+\()")
_CHECKSUM = re.compile(r"(?i)^(?:sha\d{1,3}|md5|blake2\w?|crc32)[-:=]|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^\$2[aby]?\$|^\$argon")
_NOT_SECRET_KEY = re.compile(r"(?i)(?:hash|checksum|sha\d*|md5|fingerprint|integrity|public|pub|file|path|dir)$|^max_|public[._-]?key|(?:^|[._-])(?:sha\d+|md5|commit|run[._-]?id|checksum|integrity|pub)(?:[._-]|$)")
_PASSWORD = re.compile(r"(?i)pass(?![a-z])|(?<![a-z])pw(?![a-z])|passw|passwd|pwd|passphrase|passcode|kennwort|passwort|contrase|mot de passe|senha|密码|口令")
#: A string that no key names, the whole of a literal or of a value; what its line says of checksums, ids, public keys and data speaks against it.
_LOOSE = re.compile(r"(?<![^\s\"'`=:,(\[{])(?=[^\W_a-z]*[a-z])(?=[^\W_]*?\d)[A-Za-z0-9][\w+/~-]{19,}={0,2}(?![^\s\"'`,;)\]}])", re.ASCII)
_NO_SECRET_LINE = re.compile(r"(?i)(?:hash|checksum|sha-?\d|md5|crc|digest|fingerprint|integrity|signature|public|ssh-|certificate|commit|revision|\brev\b|etag|uuid|guid|(?:^|[^a-z])ids?(?![a-z])|(?-i:[a-z]Ids?(?![a-z]))|base64|data:|h1:|nonce|\bpub|https?://)")
_ENCODED_BLOCK = re.compile(r"-----BEGIN [^-\n]+-----[\s\S]*?(?:-----END[^-\n]*-----|\Z)")
_HUMAN = re.compile(r"^[A-Za-z]{3,}(?:[-+.!_#*?&@][A-Za-z]{3,})*[-+.!_#*?&@]?\d{2,}[-+.!_#*?&@]?$")
_NAME_LIKE = re.compile(r"^_*[A-Za-z]+(?:[._-]+[A-Za-z]+)*_*\d{0,2}$|^[a-z_]++(?:[.-][a-z_]++)*\d{0,3}$")

#: The most characters a subword of values that count, by what they are made of: letters as in a name, words with digits as people
#: choose them, anything else; and by the place: of a password, of another secret, in an address.
LIMITS = {
    ("name", "password"): 2.15, ("name", "secret"): 2.15, ("name", "address"): 2.8,
    ("human", "password"): 5.0, ("human", "secret"): 4.5, ("human", "address"): 5.0,
    ("other", "password"): 4.0, ("other", "secret"): 2.75, ("other", "address"): 4.5,
    ("shape", "password"): 3.2, ("shape", "secret"): 3.2, ("shape", "address"): 3.2,
}
#: The fewest characters of such values; a short name that looks random may be an abbreviation.
LEAST = {("name", "password"): 8, ("name", "secret"): 16, ("other", "secret"): 12}


def chars_per_subword(text: str, vocabulary: str = VOCABULARY) -> float:
    """Natural words have four and more characters a subword, random strings about two."""
    encode = encoding(vocabulary).encode_ordinary
    return len(text) / max(1, sum(len(encode(text[a : a + 4096])) for a in range(0, len(text), 4096)))


def made_of(value: str) -> str | None:
    """name, human, shape or other; None for values that no secret has: numbers, and words with signs but without digits."""
    if _SHAPES.search(value):
        return "shape"
    if _NAME_LIKE.match(value):
        return "name"
    if _HUMAN.match(value):
        return "human"
    letters, digits = re.search(r"[A-Za-z]", value), re.search(r"\d", value)
    if letters and digits:
        return "other"
    return "other" if letters and re.search(r"[a-z]", value) and re.search(r"[A-Z]", value) and re.search(r"[^A-Za-z0-9_]", value) else None


_PARTS_OF_SHAPE = re.compile(r"[-_.]+")


def unnatural(value: str, place: str, vocabulary: str) -> bool:
    """Whether a value has too few characters a subword to be natural text in its place; the parts of a known shape count as words."""
    kind = made_of(value)
    if kind == "shape":
        return chars_per_subword(_PARTS_OF_SHAPE.sub(" ", value), vocabulary) < LIMITS[kind, place]
    if kind == "name" and place != "secret" and _HUMAN.match(value):
        kind = "human"  # of a name with a number only the place tells which it is
    return kind is not None and len(value) >= LEAST.get((kind, place), 6 if place != "address" else 4) and chars_per_subword(value, vocabulary) < LIMITS[kind, place]


def _usable(value: str, key: str, vocabulary: str) -> bool:
    """Whether a value in the place of a secret is one that could be used."""
    v = value.strip()
    if len(v) < 6 or re.search(r"\s", v) or _PLACEHOLDER.match(v) or _CHECKSUM.match(v):
        return False
    if not _SHAPES.search(v) and ("://" in v or "${" in v or "{{" in v or len(set(v)) < 5):
        return False
    return unnatural(v, "password" if _PASSWORD.search(key) else "secret", vocabulary)


def _unquote(m: re.Match, group: str) -> tuple[int, int, bool]:
    a, b = m.span(group)
    s = m[group]
    if s.startswith('\\"'):
        return a + 2, b - 2, True
    if s[:1] in "\"'`":
        return a + 1, b - 1, True
    while b > a and s[b - a - 1] in ",;)]}\"'`.:":
        b -= 1
    return a, b, False


def _line_spans(line: str, lower: str, vocabulary: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for m in _SHAPES.finditer(line):
        if len(set(m[0])) > 8 and unnatural(m[0], "secret", vocabulary) and not re.search(r"(?i)example|x{6}|0{6}|1234567890", m[0]):
            out.append(m.span())
    if "earer" in line or "EARER" in line:
        for m in _BEARER.finditer(line):
            if not m[1].startswith("$") and _usable(m[1], "", vocabulary):
                out.append(m.span(1))
    if "asic " in lower:
        for m in _BASIC.finditer(line):
            try:
                plain = base64.b64decode(m[1], validate=True).decode("utf-8")
            except (binascii.Error, ValueError, UnicodeDecodeError):
                continue
            user, colon, pw = plain.partition(":")
            if colon and user.isprintable() and len(pw) >= 4 and pw.isprintable() and not _PLACEHOLDER.match(pw) and unnatural(m[1], "address", vocabulary):
                out.append(m.span(1))
    if "://" in line:
        for m in _USERINFO.finditer(line):
            if not _PLACEHOLDER.match(m[1]) and "${" not in m[1] and "{" != m[1][0] and unnatural(m[1], "address", vocabulary):
                out.append(m.span(1))
        for m in _QUERY.finditer(line):
            if _usable(m[1], "", vocabulary):
                out.append(m.span(1))
    if "=" in line:
        for m in _PARTS.finditer(line):
            if _usable(m[1], "password", vocabulary):
                out.append(m.span(1))
    if "-" in line or "identified" in lower or "password '" in lower:
        for m in _FLAG.finditer(line):
            g = m.lastindex
            if _usable(m[g], "password", vocabulary):
                out.append(m.span(g))
    if "define" in lower:
        for m in _DEFINE.finditer(line):
            if _usable(m[2], m[1], vocabulary):
                out.append(m.span(2))
    if "open(" in lower or "connect(" in lower or "login(" in lower or "auth" in lower:
        for m in _OPEN.finditer(line):
            if _usable(m[1], "password", vocabulary):
                out.append(m.span(1))
    for m in _PROSE.finditer(line):
        v = m[1].rstrip(".;)")
        # in prose user names stand beside passwords; they have one case and no digits
        if not re.search(r"[/=<>(){}\[\]]", v) and (made_of(v) in ("human", "other", "shape") or made_of(v) == "name" and v.lower() != v != v.upper()) and (len(v) >= 8 or _HUMAN.match(v)) and _usable(v, "password", vocabulary) and (_HUMAN.match(v) or chars_per_subword(v, vocabulary) < 3.2):
            out.append((m.start(1), m.start(1) + len(v)))
    pos = 0
    while m := _KEYED.search(line, pos):
        pos = m.start("value") if m.end("value") > m.start("value") else m.end()
        key = m["key"]
        if _NOT_SECRET_KEY.search(key.rstrip("_-.")):
            continue
        sep = m["sep"].strip()
        if sep == "," and not m["quote"]:
            continue
        a, b, quoted = _unquote(m, "value")
        v = line[a:b]
        if not quoted and (_CODE.match(v) or sep in ("||", "??", "or", ",")):
            d = _DEFAULTED.search(line, a)
            if d and _usable(d[2], key, vocabulary):
                out.append(d.span(2))
            continue
        if not quoted and sep in ("=", ":=", ":") and "(" in v:
            continue
        if re.match(r"(?i)(?:bearer|basic)\b", v):
            continue
        joined = v
        if quoted and (j := re.match(r"""["'`]\s*[+.]\s*["'`]([^"'`]*)["'`]""", line[b:])):
            joined = v + j[1]
        if _usable(joined, key, vocabulary):
            out.append((a, b))
            if joined is not v:
                out.append((b + j.start(1), b + j.end(1)))
    return out


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in CUES:
        a.add_word(w, w)
    a.make_automaton()
    return a


def _loose(text: str, vocabulary: str) -> list[tuple[int, int]]:
    """(start, end) of the strings that no natural text would hold, whatever stands around them."""
    out, blocks = [], None
    for m in _LOOSE.finditer(text):
        v = m[0]
        if not (re.search(r"[A-Z]", v) and re.search(r"[a-z]", v) and len(re.findall(r"\d", v)) > 1) or _PLACEHOLDER.match(v) or _CHECKSUM.match(v) or len(set(v)) < 12:
            continue
        start = text.rfind("\n", 0, m.start()) + 1
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        around = text[start : m.start()] + " " + text[m.end() : end]
        if not re.search(r"\w", around) or _NO_SECRET_LINE.search(around) or chars_per_subword(v, vocabulary) >= 2:
            continue
        if blocks is None:
            blocks = [b.span() for b in _ENCODED_BLOCK.finditer(text)]
        if not any(a <= m.start() < b for a, b in blocks):
            out.append(m.span())
    return out


def secret_spans(text: str | None, vocabulary: str = VOCABULARY) -> list[tuple[int, int]]:
    """Sorted, merged (start, end) of the usable secret values in a text."""
    if not text:
        return []
    lower = text.lower()
    if len(lower) != len(text):  # some capitals have longer lower forms
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    spans: list[tuple[int, int]] = []
    end = -1
    for at, _ in _automaton().iter(lower):
        if at < end:
            continue
        start = text.rfind("\n", 0, at) + 1
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if end - start < 40 and lower[start:end].strip() == "pass":
            continue
        spans += [(start + a, start + b) for a, b in _line_spans(text[start:end], lower[start:end], vocabulary)]
    spans += _loose(text, vocabulary)
    if "value:" in lower:
        spans += [m.span(2) for m in _ENV.finditer(text) if _usable(m[2], m[1], vocabulary)]
    if "PRIVATE KEY" in text:
        for m in _PEM.finditer(text):
            body = re.sub(r"[^A-Za-z0-9+/]", "", m[1])
            if len(body) >= 24 and chars_per_subword(body, vocabulary) < 3:
                spans.append(m.span())
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each span overwritten by '*' of the same length; line breaks stay."""
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], re.sub(r"[^\r\n]", "*", text[a:b])]
        at = b
    return "".join(out) + text[at:]


def found_secrets(files: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Distinct (repository_id, file_path, line_number) of the lines on which a secret value begins."""

    name = shipped(files.sparkSession, vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[str, str, int]] = []
            for repo, path, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for n in {text.count("\n", 0, a) + 1 for a, _ in secret_spans(text, name)}:
                    rows.append((repo, path, n))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], ["repository_id", "file_path", "line_number"])

    return files.select("repository_id", "file_path", "content").mapInArrow(scan, "repository_id string, file_path string, line_number int").distinct()


def redacted(table: DataFrame, keys: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """keys, secrets (count) and content with every secret masked; null content stays null. Other columns are dropped."""

    name = shipped(table.sparkSession, vocabulary)

    @F.pandas_udf("content string, secrets int")
    def mask(texts):
        import pandas as pd

        rows = []
        for t in texts:
            spans = secret_spans(t, name)
            rows.append((redact(t, spans) if spans else t, len(spans)))
        return pd.DataFrame(rows, columns=["content", "secrets"])

    return table.select(*keys, mask("content").alias("_m")).select(*keys, "_m.secrets", "_m.content")
