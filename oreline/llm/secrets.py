"""Credentials embedded in source code, scripts and logs: find them and redact them.

Literals near assignment contexts (a name, header, tag, option or URL part that speaks of credentials) are segmented into
dictionary words by Viterbi. What no word explains is the literal's residual; a long residual is a secret. Known hash
formats, ids, placeholders, masked values, look-ups and variables are excluded. Tokens of well-known issuers and private-key
blocks are secrets wherever they stand. Encoded texts (base64, hex, percent) are decoded and searched the same way, and the
encoded form is what is then redacted.

The dictionary is the alphabetic part of a public tokenizer's vocabulary with costs by rank: a fixed list whose path is a
parameter. The operator is a narrow ``mapInPandas`` without a filter before it: it reads every text in full.

Defined results
---------------
* Null and empty texts hold nothing and stay as they are. Redacted texts hold nothing: the operator is idempotent.
* Redaction replaces the secret's characters only; quotes, keys, headers and line breaks around it stay. Of a private key the
  body between the header and the footer (or the text's end) is replaced.
* Repeated rows are each reported; other columns are dropped.
"""

from __future__ import annotations

import base64
import binascii
import functools
import re
from collections.abc import Iterator
from math import log
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.llm import tokens

MASK = "***REDACTED***"
#: Unexplained characters from which a literal in a credential context is a secret.
RESIDUAL = 4
#: Cost of a character that no word explains, and of beginning a word, in nats.
UNKNOWN, WORD_START = log(62), 3.0

# The published forms of issuers' tokens.
ISSUED = re.compile(
    r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|ASIA[0-9A-Z]{16}(?![0-9A-Za-z])"
    r"|gh[pousr]_[A-Za-z0-9_]{36,255}|github_pat_[A-Za-z0-9_]{22,255}"
    r"|xox[baprs]-[A-Za-z0-9-]{10,}"
    r"|AIza[0-9A-Za-z_-]{35}"
    r"|[srp]k_(?:live|test)_[0-9a-zA-Z]{24,}"
    r"|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}"
    r"|glpat-[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{36}"
    r"|eyJ[A-Za-z0-9_=-]{8,}\.eyJ[A-Za-z0-9_=-]{2,}\.[A-Za-z0-9_=-]+"
)
PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----((?:(?!-----)[\s\S])*+)(?:-----END|$)")
KEY_BODY = re.compile(r"[A-Za-z0-9+/=_-]{16,}")

CORE = re.compile(
    r"(?i)passw(?:or)?d|passphrase|passwd|pwd|pass(?![a-z])|secret|token|api[_-]?key|access[_-]?key|account[_-]?key|private[_-]?key|signing[_-]?key|encryption[_-]?key|storage[_-]?key|shared[_-]?key|license[_-]?key|auth|credential"
)
NAME = re.compile(r"[\w$.-]*")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
LAST_WORDS = {"password", "passwd", "pwd", "pass", "passphrase", "secret", "secrets", "token", "credential", "credentials", "apikey", "accesskey", "auth", "authorization", "passw", "authtoken", "accesstoken", "privatekey"}
LAST_PAIRS = {(a, "key") for a in ("api", "access", "account", "private", "secret", "auth", "signing", "encryption", "storage", "shared", "license")}
TRAILING = {"prod", "production", "dev", "test", "staging", "live", "old", "new", "value", "val", "str", "string", "literal", "plain", "default"}
GETTERS = {"get", "read", "load", "fetch", "find", "lookup", "resolve", "input", "prompt", "ask", "env", "getenv", "is", "has", "check", "verify", "validate", "trim", "strip", "hash", "require", "from", "parse", "decode", "getpass"}

# Quantifiers over texts of any length are possessive: every scan is linear.
QUOTED = r"""(?P<q>\\?["'`]{1,3})(?P<val>(?:(?!(?P=q))[^\n])++)(?P=q)"""
ASSIGNED = re.compile(r"""\\?["'`\]]{0,2}\s*+(?::=|=>|===?|=|:)\s*+(?:[bfru]{0,2}""" + QUOTED + r"""|(?P<bare>[^\s"'`<>,;(){}\[\]|&]++)(?P<call>[(\[{]?))""")
LISTED = re.compile(r"""\\?["'`]\s*+,\s*+""" + QUOTED)
CALLED = re.compile(r"""\s*+\(\s*+""" + QUOTED)
PAIRED = re.compile(r"""\s*+(?::=|=|:)\s*+[\[(]\s*+(?:"[^"\n]*+"|'[^'\n]*+')\s*+,\s*+""" + QUOTED)
TAGGED = re.compile(r""">\s*+(?P<val>[^<>\s]++)\s*+</""")
OPTION = re.compile(r"""\s++(?:""" + QUOTED + r"""|(?P<bare>[^\s"'`<>;(){}|&]++)(?P<call>[(]?))""")
SCHEME = re.compile(r"(?i)^(?:basic|bearer|token|digest|apikey)\s+")
IN_URL = re.compile(r"://[^\s/:@\"'<>]*+:(?P<val>[^\s/@\"']++)@")
SHORT_P = re.compile(r"""(?<![\w-])-p\s?(?:(?P<q>["'])(?P<val>[^"'\n]+)(?P=q)|(?P<bare>[^\s"'`<>;(){}|&/-][^\s"'`<>;(){}|&]*))""")
SHORT_U = re.compile(r"""(?<![\w-])(?:-u|--user)[\s=]++["']?[^\s:"'$]++:(?P<val>[^\s"']++)""")
#: Unquoted access to a member: a variable or a look-up, no literal.
MEMBER = re.compile(r"^[A-Za-z_$][\w$]*(?:(?:\??\.|->|::)[A-Za-z_$][\w$]*)+;?$")
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
PERCENT_CODE = re.compile(r"%[0-9A-Fa-f]{2}")
#: A percent sign that was itself encoded, any number of times.
PERCENT_AGAIN = re.compile(r"%(?:25)++(?=[0-9A-Fa-f]{2})")
#: Runs that may hold percent codes; those with fewer than two are passed over.
PERCENT = re.compile(r"[^\s\"'`<>]+")

# Lengths of common digests in hexadecimal; forms of password hashes and ids.
HEX_DIGESTS = {32, 40, 48, 56, 64, 96, 128}
HASHED = re.compile(r"^(?:\$(?:1|2[abxy]?|5|6|y|argon2\w*|scrypt|pbkdf2[\w-]*)\$|\{S?SHA\d*\}|(?:md5|sha-?\d{1,3})[-:=]|pbkdf2[:_]|scrypt:)", re.I)
UUID = re.compile(r"^[{(]?[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}[)}]?$", re.I)
PLACEHOLDER = re.compile(
    r"""(?ix) \*{3,} | ^[*x.\-_#•?0]+$ | \$\{ | \$\( | ^\$[A-Za-z_] | \{\{ | ^\{\w*\}$ | ^<[^>]*>?$ | ^\[[^\]]*\]?$ | ^%[sdvq(] | ^%\w+%$ | \.\.\. | …
    | redacted | your[_-]?\w*[_-]?(key|token|secret|password) | ^your[_-] | change[_-]?me | replace[_-]?(me|with) | placeholder | ^(todo|tbd|fixme|dummy|sample|example|none|null|nil|true|false|undefined|empty)$ | ^x{4,}"""
)


@functools.lru_cache(maxsize=2)
def dictionary(path: str = tokens.VOCABULARY) -> dict[str, float]:
    """Words of three or more letters and their costs."""
    out: dict[str, float] = {}
    for token, rank in tokens.encoding(path)._mergeable_ranks.items():
        word = token.decode("ascii", "ignore").strip().lower()
        if len(word) >= 3 and word.isalpha() and len(word) >= len(token) - 1:
            cost = WORD_START + log(rank + 50)
            out[word] = min(out.get(word, cost), cost)
    for word in ("passwd", "pwd", "svc", "env", "db", "api", "url", "id"):
        out.setdefault(word, WORD_START + 7.0)
    return out


@functools.lru_cache(maxsize=200_000)
def _unexplained_word(letters: str, path: str) -> int:
    return _segmented(letters, path)


def unexplained(letters: str, path: str = tokens.VOCABULARY) -> int:
    """Letters of a run that the cheapest segmentation into words leaves over. A word is written in lower case, in capitals or
    with a capital first letter; other mixtures explain nothing."""
    return _unexplained_word(letters, path) if len(letters) <= 64 else _segmented(letters, path)


def _segmented(letters: str, path: str) -> int:
    words, n = dictionary(path), len(letters)
    low = letters.lower()
    cost, over = [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        best, left = cost[i - 1] + UNKNOWN, over[i - 1] + 1
        for j in range(max(0, i - 18), i - 1):
            w = words.get(low[j:i])
            if w is not None and cost[j] + w < best:
                part = letters[j:i]
                if part[1:].islower() or part.isupper():
                    best, left = cost[j] + w, over[j]
        cost[i], over[i] = best, left
    return over[n]


RUNS = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+")


def residual(value: str, path: str = tokens.VOCABULARY) -> int:
    """Characters of a literal that dictionary words, separators and plain numbers do not explain."""
    out = digits = marks = 0
    for run in RUNS.findall(value):
        if run[0].isdigit():
            digits += len(run)
        elif run[0].isalpha() and run.isascii():
            out += unexplained(run, path)
        else:
            marks += sum(c not in "_-./ :,\\" for c in run)
    mixed = digits and any(c.isalpha() for c in value)
    return out + (digits + marks if mixed else 0)


def name_words(name: str) -> list[str]:
    return [w.lower() for w in CAMEL.findall(name)]


def speaks_of_credentials(name: str) -> bool:
    """Whether a name ends in a word for a credential (``token_store`` and ``secret_name`` do not)."""
    w = [x for x in name_words(name) if not x.isdigit()]
    while len(w) > 1 and w[-1] in TRAILING:
        w.pop()
    return bool(w) and (w[-1] in LAST_WORDS or tuple(w[-2:]) in LAST_PAIRS)


def is_hash(value: str) -> bool:
    bare = value.lower()
    return bool(HASHED.match(value) or UUID.match(value) or (len(value) in HEX_DIGESTS and all(c in "0123456789abcdef" for c in bare)))


def is_secret(value: str, least: int = RESIDUAL, path: str = tokens.VOCABULARY) -> bool:
    """Whether a literal in a credential context is a live credential."""
    if PLACEHOLDER.search(value) or is_hash(value) or value.replace(".", "").isdigit():
        return False
    if "PUBLIC KEY" in value or value.startswith(("http://", "https://", "ssh-rsa ", "ssh-ed25519 ")) and ":" not in value[8:]:
        return False
    left = residual(value, path)
    if value.startswith(("/", "./", "~/")) and ":" not in value[8:] and 2 * left < len(value):
        return False  # a path: mostly words
    return left >= least


def decoded(raw: str) -> str | None:
    """The readable text that a base64 or hexadecimal token stands for, else None."""
    bare = raw.rstrip("=")
    if len(bare) % 2 == 0 and len(bare) >= 16 and all(c in "0123456789abcdefABCDEF" for c in bare):
        data = bytes.fromhex(bare)
    else:
        try:
            data = base64.b64decode(bare.translate(str.maketrans("-_", "+/")) + "=" * (-len(bare) % 4), validate=True)
        except (binascii.Error, ValueError):
            return None
    if len(data) < 8:
        return None
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if all(c.isprintable() or c in "\r\n\t" for c in text) else None


def _literal(m: re.Match, at: int = 0) -> tuple[str, int, int, bool] | None:
    """The value a context names, its place, and whether it is quoted."""
    groups = m.groupdict()
    if groups.get("val") is not None:
        return groups["val"], m.start("val"), m.end("val"), True
    if groups.get("bare") is not None and not groups.get("call"):
        return groups["bare"], m.start("bare"), m.end("bare"), False
    return None


def _contexts(text: str) -> Iterator[tuple[str, int, int, int]]:
    """(value, first, last + 1, least residual) of the literals that credential contexts name."""
    seen = -1
    for m in CORE.finditer(text):
        if m.start() < seen:
            continue
        a = m.start()
        floor = max(0, seen)
        while a > floor and (text[a - 1].isalnum() or text[a - 1] in "_$.-"):
            a -= 1
        b = NAME.match(text, m.end()).end()
        seen = b
        while b > m.end() and text[b - 1] in ".-":
            b -= 1
        name = text[a:b].strip("-.$")
        if not speaks_of_credentials(name.rsplit(".", 1)[-1]):
            continue
        before = text[a - 1] if a else ""
        if before == "<" and (t := TAGGED.match(text, b)):
            yield t["val"], t.start("val"), t.end("val"), RESIDUAL
            continue
        words = name_words(name.rsplit(".", 1)[-1])
        for form in (PAIRED, ASSIGNED, *((LISTED,) if before in ("'", '"', "`") else ()), *((CALLED,) if not GETTERS & set(words) else ()), *((OPTION,) if text[max(0, a - 2) : a] == "--" or text[a : a + 2] == "--" else ())):
            if (t := form.match(text, b)) and (x := _literal(t)):
                value, i, j, quoted = x
                if quoted or not MEMBER.match(value):
                    yield value, i, j, RESIDUAL
                break
    for form, least in ((IN_URL, RESIDUAL), (SHORT_P, RESIDUAL + 1), (SHORT_U, RESIDUAL)):
        for m in form.finditer(text):
            if x := _literal(m):
                yield x[0], x[1], x[2], least


def percent_decoded(raw: str) -> str:
    """The text behind percent codes, also where they were encoded more than once."""
    return unquote(PERCENT_AGAIN.sub("%", raw))


def find(text: str | None, path: str = tokens.VOCABULARY) -> list[tuple[int, int, str]]:
    """(first, last + 1, kind) of every secret of a text, in order and not overlapping."""
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    for m in PRIVATE_KEY.finditer(text):
        if KEY_BODY.search(m[1].replace("\\n", "\n")) and MASK not in m[1]:
            out.append((m.start(1), m.end(1), "private key"))
    for m in ISSUED.finditer(text):
        if not PLACEHOLDER.search(m[0]) and residual(m[0], path) >= 8:
            out.append((m.start(), m.end(), "issued token"))
    for value, a, b, least in _contexts(text):
        if (s := SCHEME.match(value)):
            value, a = value[s.end() :], a + s.end()
        elif value.lower() in ("basic", "bearer", "token", "digest") and (s := re.compile(r"\s+([^\s\"'`,;]+)").match(text, b)):
            value, a, b = s[1], s.start(1), s.end(1)
        plain = decoded(value) if ENCODED.fullmatch(value) else None
        if plain is not None and ":" in plain:  # user and password of basic authentication
            if is_secret(plain.split(":", 1)[1], least, path):
                out.append((a, b, "encoded"))
        elif is_secret(value, least, path):
            out.append((a, b, "literal"))
    for form, decode in ((ENCODED, decoded), *(((PERCENT, percent_decoded),) if "%" in text else ())):
        for m in form.finditer(text):
            if form is PERCENT and len(PERCENT_CODE.findall(m[0])) < 2:
                continue
            plain = decode(m[0])  # shorter than m[0], so that nested encodings end
            if plain and len(plain) < len(m[0]) and find(plain, path):
                out.append((m.start(), m.end(), "encoded"))
    out.sort(key=lambda x: (x[0], -x[1]))
    kept: list[tuple[int, int, str]] = []
    for a, b, kind in out:
        if kept and a < kept[-1][1]:
            kept[-1] = (kept[-1][0], max(b, kept[-1][1]), kept[-1][2])
        elif b > a:
            kept.append((a, b, kind))
    return kept


def redact(text: str | None, path: str = tokens.VOCABULARY) -> str | None:
    """The text with every secret replaced, all else unchanged."""
    if not text:
        return text
    out, last = [], 0
    for a, b, kind in find(text, path):
        body = text[a:b]
        lead, tail = (body[: len(body) - len(body.lstrip("\r\n"))], body[len(body.rstrip("\r\n")) :]) if kind == "private key" else ("", "")
        out += [text[last:a], lead, MASK, tail]
        last = b
    return "".join([*out, text[last:]])


def texts_of(rows: DataFrame, table_name: str, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """(table_name, record_id, field_name, text), one row per field that is not null."""
    each = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields))
    return rows.select(F.lit(table_name).alias("table_name"), F.col(id_col).cast("string").alias("record_id"), F.explode(each).alias("x")).select("table_name", "record_id", "x.field_name", "x.text").where("text is not null")


def find_secrets(texts: DataFrame, path: str = tokens.VOCABULARY) -> DataFrame:
    """The places of all secrets: table_name, record_id, field_name, start, end (characters) and kind."""
    kind = "table_name string, record_id string, field_name string, start int, end int, kind string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(t, r, f, a, b, k) for t, r, f, x in pdf[["table_name", "record_id", "field_name", "text"]].itertuples(index=False) for a, b, k in find(x, path)]
            yield pd.DataFrame(rows, columns=["table_name", "record_id", "field_name", "start", "end", "kind"])

    return texts.select("table_name", "record_id", "field_name", "text").mapInPandas(run, kind)


def redact_texts(texts: DataFrame, path: str = tokens.VOCABULARY) -> DataFrame:
    """The texts free of secrets, with the number replaced."""
    kind = "table_name string, record_id string, field_name string, text string, n_redacted int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = [len(find(x, path)) for x in pdf["text"]]
            text = [redact(x, path) if k else x for x, k in zip(pdf["text"], n)]
            yield pdf[["table_name", "record_id", "field_name"]].assign(text=text, n_redacted=pd.Series(n, dtype="int32", index=pdf.index))

    return texts.select("table_name", "record_id", "field_name", "text").mapInPandas(run, kind)
