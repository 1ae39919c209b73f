"""Problem 5: credentials embedded in source code.

One deterministic automaton (Aho-Corasick over the literals below) reads a text once and stops at
every place where a token format, a key armor, a connection string, an authorization header, a
command-line login, an SQL login or a named value may begin; the grammar of that literal then
decides at that place, on the whole text, so that no credential is too long.  Long texts are read by the automaton in
chunks that overlap by the longest literal; spans are absolute and deduplicated.  ``redact`` splices placeholders
into the spans and leaves all else as it was.

Defined results: null content gives no span and null redacted text; empty content stays empty.
"""

from __future__ import annotations

import base64
import binascii
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk that the automaton reads at once.
CHUNK = 1 << 13

# ---- token formats: literal prefix and the pattern at it (fixed values)
FORMATS = {
    "AKIA": r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "ASIA": r"ASIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "ghp_": r"ghp_[A-Za-z0-9]{30,}",
    "gho_": r"gho_[A-Za-z0-9]{30,}",
    "ghs_": r"ghs_[A-Za-z0-9]{30,}",
    "github_pat_": r"github_pat_\w{22,}",
    "glpat-": r"glpat-[\w-]{20,}",
    "xoxb-": r"xoxb-[A-Za-z0-9-]{20,}",
    "xoxp-": r"xoxp-[A-Za-z0-9-]{20,}",
    "sk-": r"sk-[A-Za-z0-9_-]{20,}",
    "sk_live_": r"sk_live_[A-Za-z0-9]{16,}",
    "rk_live_": r"rk_live_[A-Za-z0-9]{16,}",
    "qk_live_": r"qk_live_[A-Za-z0-9]{16,}",
    "zpat-": r"zpat-[A-Za-z0-9]{20,}",
    "nbl.": r"nbl\.[A-Za-z0-9]{20,}",
    "AIza": r"AIza[\w-]{35}",
    "npm_": r"npm_[A-Za-z0-9]{36}",
    "pypi-": r"pypi-[\w-]{50,}",
    "hf_": r"hf_[A-Za-z0-9]{30,}",
    "SG.": r"SG\.[\w-]{16,}\.[\w-]{16,}",
    "sk_test_": r"sk_test_[A-Za-z0-9]{16,}",
    "whsec_": r"whsec_[A-Za-z0-9]{24,}",
    "shpat_": r"shpat_[a-fA-F0-9]{32}",
    "dop_v1_": r"dop_v1_[a-f0-9]{64}",
    "glsa_": r"glsa_[A-Za-z0-9]{32}_[a-fA-F0-9]{8}",
    "dckr_pat_": r"dckr_pat_[\w-]{20,}",
    "xoxa-": r"xoxa-[A-Za-z0-9-]{20,}",
    "xoxr-": r"xoxr-[A-Za-z0-9-]{20,}",
    "ya29.": r"ya29\.[\w-]{20,}",
    "AGE-SECRET-KEY-1": r"AGE-SECRET-KEY-1[A-Z0-9]{50,}",
    "eyJ": r"eyJ[\w-]{8,}={0,2}\.eyJ[\w-]{4,}={0,2}\.[\w-]{16,}",
}
_FORMAT = {k.lower(): re.compile(rf"(?<![A-Za-z0-9_\-]){v}") for k, v in FORMATS.items()}
_ARMOR = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BEGIN = re.compile(r"-----BEGIN ")
#: What a key without an end consists of: runs of base64, and what a language or a header puts between them.
_KEY_RUNS = re.compile(r"(?:(?:[\s\"'`,;|*#>]|\\[rn]|\+(?=\s)|[A-Z][\w-]*: [^\n\\]*)*+[A-Za-z0-9+/=]{16,})+(?:(?:[\s\"'`,]|\\[rn])*[A-Za-z0-9+/=]{2,}(?=[\s\"'`\\]|\Z))?")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_URL = re.compile(r"://([^\s:/@\"'`<>]*):([^\s/\"'`<>]*(?:/(?=[^\s/\"'`<>@]*@)[^\s/\"'`<>]*)*)@(?=[\w\[.$%{-])")
_AUTH = re.compile(r"(?i)(?:proxy-)?authorization[\"']?\s*[:=,]\s*[\"']?\s*(bearer|basic|token|digest|apikey)\s+([^\s\"'`,;<>]+|<[^>\n]*>)")
_BEARER = re.compile(r"(?i)\bbearer[ \t]+([A-Za-z0-9._~+/=-]{12,})")
_CURL = re.compile(r"(?:(?<=\s)-u|--user)(?:\s+|=)[\"']?([^\s:\"']+):([^\s\"']+)")
_SQL = re.compile(r"(?i)(?:identified\s+(?:with\s+\w+\s+)?by|\bpassword)\s+(?:password\s+)?(['\"])((?:(?!\1)[^\n])*)\1")
_NETRC = re.compile(r"(?i)password\s+(\S+)")
_TAG = re.compile(r"<([\w.:-]+)(?:\s[^<>]*)?>([^<>\s]+)</\1\s*>")

# ---- named values
_SECRET_WORDS = frozenset("password passwd pwd pass passphrase secret token bearer credential credentials apikey apitoken authtoken accesskey secretkey privatekey passcode".split())
_KEY_BEFORE = frozenset("api access secret signing encryption private auth master client service account shared deploy license jwt hmac session storage webhook encrypt crypto cipher app application admin".split())
_NOT_BEFORE = frozenset("public pub primary foreign partition sort cache index map row".split())
_PART = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")
_NAME = r"[A-Za-z_$][\w$.\-]*"
# what may stand between a name and its value
_GAP = re.compile(
    r"""(?P<q>\\?["'`]|["']?\])?[ \t]*(?:(?P<type>\??:[ \t]*(?:&(?:'static[ \t]+)?)?[A-Za-z_][\w.<>\[\]?|]*[ \t]*(?==))?(?P<op>:=|=>|=(?!=)|:(?!:)|,)|(?P<put>\\?["'`]?[ \t]*\)?[ \t]*\([ \t]*(?=["'`])))[ \t]*(?:\\?\n[ \t]*(?=["'`]))?"""
)
_QUOTED = re.compile(r"(?:[brufBRUFL@$]{0,2})(\\?[\"'`])((?:(?!\1)(?:\\[^\n]|[^\\\n]))*+)\1")
_JOIN = re.compile(r"[ \t]*[+.]?[ \t]*\\?\n?[ \t]*(?:\+[ \t]*)?(?=[\"'`])")
_BARE = re.compile(r"[^\s\"'`,;()<>{}\[\]#][^\s\"'`,;()<>{}\[\]]*+")
_LINE_REST = re.compile(r"[ \t]*(?:[#;][^\n]*|//[^\n]*|\*/[^\n]*|-->[^\n]*|\.|,)?[ \t]*(?=\r?\n|\Z)")
_CODE = re.compile(r"(?i)\.(?:py|js|jsx|ts|tsx|java|go|c|h|cc|cpp|hpp|cs|kt|rs|swift|scala|php|rb|json)$")
_COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|--|<!--|;)|\s(?://|#|/\*|--)\s")

_PLACE = re.compile(
    r"(?ix) ^(?:"
    r"<.*>|\$\{.*\}?|\$\(.*|\$[A-Za-z_]\w*|%[A-Za-z_]\w*%|\{\{.*|\{[A-Za-z_.]\w*\}|%\(.*|%[sd]|\#\{.*|@[\w.]+@|\[.*\]|\(.*\)"
    r"|[*.x?\-_•#]+|x{3,}.*|\*{3,}.*|.*\*{4,}|\.{3}.*"
    r"|(?:your|my|the|some|insert|enter|put|add|set|use|replace|change|fill|paste|type)[\W_]?.*(?:here|me|this|token|key|password|secret)?"
    r"|.*[_\-\s](?:here|goes[_\-\s]here)|replace.?me|change.?me|fix.?me|to.?do|tbd|none|null|nil|undefined|true|false|yes|no|n/?a|empty|default|example.*|sample.*|dummy.*|placeholder.*|redacted.*|removed|hidden|masked"
    r"|(?:env|vault|ssm|secret|secrets|file|arn|op|aws|gcp|azure|kms|keyring|keychain|sops|ref|config):.*|!\w+.*"
    r"|(?:/|\./|\.\./|~/).*|[A-Za-z]:\\.*|[\w./-]+\.(?:pem|key|crt|cer|pub|txt|json|ya?ml|env|conf|cfg|p12|jks|py|js|go|c|h|java|ts|sh|md|html)"
    r"|https?://.*|(?:os|process|System|config|settings|env|ENV|viper|secrets|vault|self|this|request|req|ctx|args|opts|options|app|props)\.\w.*|getenv.*|(?:ssh-(?:rsa|dss|ed25519)|ecdsa-\S+)\b.*"
    r")$"
)


@lru_cache(maxsize=100_000)
def secret_name(name: str) -> bool:
    """Whether an identifier names a credential itself, not its length, header, path, digest or the like."""
    parts = [p.lower() for p in _PART.findall(name)]
    while parts and (parts[-1].isdigit() or parts[-1] in ("value", "val", "str", "string", "text", "plain", "raw")) and len(parts) > 1:
        parts.pop()
    if not parts:
        return False
    last, before = parts[-1], parts[-2] if len(parts) > 1 else ""
    if last in _SECRET_WORDS or "".join(parts[-2:]) in _SECRET_WORDS:
        return before not in _NOT_BEFORE and not (before in ("no", "has", "is", "show", "hide", "f", "field", "max", "min", "invalid", "next"))
    return last in ("key", "keys") and before in _KEY_BEFORE


def _digits_letters(v: str) -> bool:
    return any(c.isdigit() for c in v) and any(c.isalpha() for c in v)


def credential_value(v: str, name: str = "", quoted: bool = True) -> bool:
    """Whether a value written behind a credential's name is one, not a placeholder, reference, label or expression."""
    if len(v) < 6 or any(c.isspace() for c in v):
        return False
    if _PLACE.match(v) and not (v[0] == "/" and len(v) >= 16 and sum(a.islower() != b.islower() for a, b in zip(v, v[1:])) > len(v) // 4):
        return False
    if v.startswith(("-----BEGIN", "$", "%{", "{{")) or "${" in v or "{{" in v:
        return False
    if re.fullmatch(r"[\w.]+(?:\(.*\)?|\[.*\]?)", v):  # a call or an index
        return False
    if v.isdigit():
        return len(v) >= 8 and quoted
    if _digits_letters(v):
        return quoted or not re.fullmatch(r"[A-Za-z_]\w*[._]x", v)
    if re.fullmatch(r"[A-Za-z]+(?:[_\-. ][A-Za-z]+)*", v):  # words only: a label, unless upper and lower case mix as by chance
        turns = sum(a.islower() != b.islower() for a, b in zip(v, v[1:]))
        return len(v) >= 10 and turns >= 4 and not re.fullmatch(r"(?:[A-Z][a-z]{2,}|[a-z]{3,}|[A-Z]{2,})(?:[_\-.]?(?:[A-Z][a-z]{2,}|[a-z]{3,}|[A-Z]{2,}))*", v)
    letters = sum(c.isalpha() for c in v)
    turns = sum(a.islower() != b.islower() for a, b in zip(v, v[1:]) if a.isalpha() and b.isalpha())
    return quoted and letters >= 5 and (turns >= 2 or any(c in "!@#$%^&*+~" for c in v)) and len(v) >= 8


_LITERALS: dict[str, str] = {k.lower(): "format" for k in FORMATS}
_LITERALS |= {"-----begin": "armor", "://": "url", "authorization": "auth", "bearer": "bearer", "-u": "curl", "--user": "curl", "identified": "sql", "password": "name"}
_LITERALS |= dict.fromkeys(["passwd", "pwd", "pass", "passphrase", "passcode", "secret", "token", "credential", "apikey", "key"], "name")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, v in _LITERALS.items():
        a.add_word(k, (v, len(k), k))
    a.make_automaton()
    return a


_IDENT = re.compile(r"[\w$.\-]")
_IDENT_LEFT = re.compile(r"[\w$.\-]*\Z")
_WORDLY = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_-.")
_IDENT_RIGHT = re.compile(r"[\w$\-.]*")


class Seen:
    """What has been read of a text, so that no stretch of it is read at every hit within: where the last identifier begins, the last run without
    a delimiter with its last digit and its last character that is in no word, the end of the next key, and where the last credential ends."""

    def __init__(self):
        self.at = self.left = self.start = self.stop = self.digit = self.odd = self.skip = self.key = -1
        self.end: re.Match | None = None
        self.ended = -1


def _left(text: str, at: int, seen: Seen) -> int:
    """Where the identifier that reaches ``at`` begins."""
    left = at
    while left > 0 and (text[left - 1].isalnum() or text[left - 1] in "_$.-"):
        left -= 1
        if left == seen.at:
            left = seen.left
            break
    seen.at, seen.left = at, left
    return left


def _bare(text: str, p: int, seen: Seen) -> int | None:
    """Where the run without a delimiter that begins at ``p`` ends."""
    if not seen.start <= p < seen.stop:
        m = _BARE.match(text, p)
        if not m:
            return None
        seen.start, seen.stop = p, m.end()
        seen.digit = next((i for i in range(m.end() - 1, p - 1, -1) if text[i].isdigit()), -1)
        seen.odd = next((i for i in range(m.end() - 1, p - 1, -1) if text[i] not in _WORDLY), -1)
    return None if text[p] == "#" else seen.stop


def _next_end(text: str, at: int, seen: Seen) -> re.Match | None:
    """The next end of a key."""
    if seen.ended < 0 or (seen.end and seen.end.start() < at):
        seen.end, seen.ended = _END.search(text, at), at
    return seen.end


def _after_login(text: str, at: int) -> bool:
    """Whether the word before the last one before ``at`` names a login, as in a netrc file."""
    if not text[at - 1 : at].isspace():
        return False
    ends = []
    for _ in range(2):
        while at and text[at - 1].isspace():
            at -= 1
        ends.append(at)
        while at and not text[at - 1].isspace():
            at -= 1
        ends.append(at)
    return ends[1] < ends[0] and text[ends[3] : ends[2]].lower() in ("login", "account")


def _named(text: str, at: int, end: int, code: bool, seen: Seen) -> tuple[int, int, str] | None:
    """A value behind the identifier around text[at:end]."""
    left = _left(text, at, seen)
    right = _IDENT_RIGHT.match(text, end).end()
    name = text[left:right]
    stripped = name.rstrip(".-")
    right -= len(name) - len(stripped)
    if right < end or not secret_name(stripped):
        return None
    m = _GAP.match(text, right)
    if not m:
        # Dockerfile: ENV NAME value; argument: --password value
        line = text[text.rfind("\n", 0, left) + 1 : left]
        if re.fullmatch(r"\s*(?:ENV|ARG)\s+", line) or stripped.startswith("--"):
            m = re.compile(r"[ \t]+").match(text, right)
            stop = _bare(text, m.end(), seen) if m else None
            if stop and credential_value(text[m.end() : stop], stripped, False):
                return m.end(), stop, "value"
        return None
    p = m.end()
    if m["op"] == "," and not m["q"]:
        return None
    q = _QUOTED.match(text, p)
    if q:
        v, start_of_value = q[2], q.start(2)
        if m["put"] and not re.search(r"(?i)(?:set|with|put|add|pass|token|secret|key|pwd)", stripped):
            return None
        rest = text[q.end() : q.end() + 40]
        if re.match(r"\s*(?:%(?!\w*\")|\.format|\[|in\b)", rest):
            return None
        stop = q.end(2)
        while True:  # a literal put together of parts is one credential
            more = _JOIN.match(text, q.end())
            q2 = _QUOTED.match(text, more.end()) if more else None
            if not q2:
                break
            v, stop, q = v + q2[2], q2.end(2), q2
        if credential_value(v.rstrip("\\"), stripped):
            return start_of_value, stop, "value"
        return None
    if m["put"] or m["op"] == ",":
        return None
    before = text[text.rfind("\n", 0, left) + 1 : left]
    in_string = text[left - 1 : left] in "\"'" and not m["q"] if left else False
    if code and not in_string and not _COMMENT.search(before + " "):
        if not any(q in before for q in "\"'`"):  # else it stands inside a string, as a header or argument does
            return None
        in_string = True
    stop = _bare(text, p, seen)
    if not stop or seen.digit < p <= seen.odd:  # without a digit, a bare value is one word at most
        return None
    v = text[p:stop]
    whole = _LINE_REST.match(text, stop) or (in_string and text[stop : stop + 1] in "\"'`&;, ")
    if not whole and not re.match(r"[,;&|)}\]]|[ \t]+(?:&&|\||\\)", text[stop : stop + 3]) and not (not code and re.match(r"[ \t]", text[stop : stop + 1]) and _digits_letters(v)):
        return None
    if text[stop : stop + 1] in "([{<" and text[stop : stop + 1]:
        return None
    v2 = v.rstrip(".") if code else v
    if credential_value(v2, stripped, False):
        return p, p + len(v2), "value"
    return None


def _url(text: str, at: int) -> tuple[int, int, str] | None:
    m = _URL.match(text, at)
    if not m:
        return None
    v = m[2]
    if not v or _PLACE.match(v) or v.startswith(("$", "<", "{", "%s", "%(")) or "${" in v or "{{" in v or re.fullmatch(r"(?i)(?:pass(?:word|wd)?|pwd|secret|token|user|x+|\*+)", v):
        return None
    return m.start(2), m.end(2), "url"


def scan(text: str, code: bool, seen: Seen, lo: int = 0, hi: int | None = None) -> set[tuple[int, int, str]]:
    """Spans (start, end, kind) of credentials whose literal stands in text[lo:hi]; they may reach beyond."""
    found: set[tuple[int, int, str]] = set()
    part = text[lo:hi]
    low = part.lower()
    if len(low) != len(part):  # letters whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in part)
    for last, (kind, n, word) in automaton().iter(low):
        last += lo
        at = last - n + 1
        if at < seen.skip and (kind != "format" or at < seen.key):
            continue
        hit = None
        if kind == "name":
            nxt = text[last + 1 : last + 2].lower()
            if word == "pass" and nxt in ("w", "p", "c"):
                continue
            hit = _named(text, at, last + 1, code, seen)
        elif kind == "url":
            hit = _url(text, at)
        elif kind == "format":
            m = _FORMAT[word].match(text, at)
            if m and not re.search(r"(?i)example|x{6,}|0{8,}", m[0]):
                hit = (m.start(), m.end(), "token")
        elif kind == "armor":
            m = _ARMOR.match(text, at)
            if m:
                e = _next_end(text, m.end(), seen)
                if e and _BEGIN.search(text, m.end(), e.start()):
                    e = None  # the end of another
                r = None if e else _KEY_RUNS.match(text, m.end())
                stop = e.start() if e else r.end() if r else m.end()
                if sum(map(len, re.findall(r"[A-Za-z0-9+/=]{16,}", text[m.end() : stop]))) >= 40:
                    hit = (m.start(), e.end() if e else stop, "private_key")
        elif kind == "auth":
            m = _AUTH.match(text, at)
            if m and not _PLACE.match(m[2]) and "${" not in m[2] and "$" != m[2][0]:
                v = m[2]
                if m[1].lower() == "basic":
                    try:
                        ok = b":" in base64.b64decode(v + "=" * (-len(v) % 4), validate=True)
                    except (binascii.Error, ValueError):
                        ok = False
                else:
                    ok = credential_value(v, "", True)
                if ok:
                    hit = (m.start(2), m.end(2), "header")
        elif kind == "bearer":
            m = _BEARER.match(text, at)
            if m and _digits_letters(m[1]) and credential_value(m[1]):
                hit = (m.start(1), m.end(1), "header")
            else:
                hit = _named(text, at, last + 1, code, seen)
        elif kind == "curl":
            m = _CURL.match(text, at)
            if m and re.search(r"(?:curl|wget|http)\b", text[max(0, text.rfind("\n", 0, at)) : at]) and credential_value(m[2], "", True):
                hit = (m.start(2), m.end(2), "login")
        elif kind == "sql":
            m = _SQL.match(text, at)
            if m and credential_value(m[2], "", True):
                hit = (m.start(2), m.end(2), "login")
        if hit is None and word in ("password", "passwd", "pass", "secret", "token", "key"):
            m = _SQL.match(text, at) if word == "password" else None
            n = _NETRC.match(text, at) if word == "password" and _after_login(text, at) else None
            if m and credential_value(m[2], "", True):
                hit = (m.start(2), m.end(2), "login")
            elif n and credential_value(n[1], "", True):
                hit = (n.start(1), n.end(1), "login")
            elif text[at - 1 : at] != "/" and text[_left(text, at, seen) - 1 : _left(text, at, seen)] in ("<", ":"):
                t = _TAG.match(text, text.rfind("<", 0, at))
                if t and secret_name(t[1]) and credential_value(t[2], t[1], True):
                    hit = (t.start(2), t.end(2), "value")
        if hit:
            found.add(hit)
            seen.skip = max(seen.skip, hit[1])
            if hit[2] == "private_key":
                seen.key = hit[1]
    return found


def spans(text: str, path: str | None, chunk: int = CHUNK) -> list[tuple[int, int, str]]:
    """Absolute spans of the credentials of a text, sorted, none inside another; read in chunks that overlap by the longest literal."""
    code = bool(_CODE.search(path or ""))
    overlap = max(map(len, _LITERALS))
    found: set[tuple[int, int, str]] = set()
    seen = Seen()
    for a in range(0, len(text), chunk):
        found |= scan(text, code, seen, a, a + chunk + overlap)
    out: list[tuple[int, int, str]] = []
    for s in sorted(found, key=lambda s: (s[0], -s[1], s[2])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with ``[REDACTED_<KIND>]`` in place of each span; lines inside a key are kept as lines."""
    out, at = [], 0
    for s, e, kind in found:
        out += [text[at:s], f"[REDACTED_{kind.upper()}]", "\n" * text.count("\n", s, e)]
        at = e
    return "".join([*out, text[at:]])


# ---------------------------------------------------------------- Spark
def credential_spans(files: DataFrame, id_col: str = "file_id", path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(``id_col``, line_no, start_pos, end_pos, kind): one row per credential; positions from 1 in code points. No shuffle."""
    rows = files.select(F.col(id_col).cast("long").alias("__id"), F.col(path_col).alias("__path"), F.col(content_col).alias("__text")).filter(F.col("__text").isNotNull())
    schema = pa.schema([("__id", pa.int64()), ("line_no", pa.int64()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("kind", pa.string())])

    def run(batches):
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for i, path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                line, at = 1, 0
                for s, e, k in spans(text, path):
                    line += text.count("\n", at, s)
                    at = s
                    for c, v in zip(cols, (i, line, s + 1, e + 1, k)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return rows.mapInArrow(run, "__id long, line_no long, start_pos long, end_pos long, kind string").withColumnRenamed("__id", id_col)


def redacted(files: DataFrame, id_col: str = "file_id", path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(``id_col``, credentials, ``content_col``): every row, its text with placeholders for credentials."""
    rows = files.select(F.col(id_col).cast("long").alias("__id"), F.col(path_col).alias("__path"), F.col(content_col).alias("__text"))

    def run(batches):
        for b in batches:
            n, out = [], []
            for path, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = spans(text, path) if text else []
                n.append(len(found))
                out.append(redact(text, found) if found else text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(out, pa.string())], names=["__id", "credentials", "__text"])

    return rows.mapInArrow(run, "__id long, credentials int, __text string").withColumnRenamed("__id", id_col).withColumnRenamed("__text", content_col)
