"""Problem 9: personal information inside free text.

E-mail addresses, phone numbers, identity numbers and street addresses are told by their form and
the words beside them.  Names have no form: what stands in places only names stand in (a commit's author,
a signature, beside a phone or identity number) is a name.  A first pass over all documents gathers the given
and family names of such places, a second finds every pair of them elsewhere too, in either order and any case.

Each detected entity is replaced by a surrogate that depends on a secret key and the entity alone: the
same person or number has the same surrogate everywhere (coreference), different ones have different
surrogates (collisions are looked for over the whole corpus and rehashed, in texts and in ``surrogate_table`` alike).
The surrogate is a typed placeholder with a keyed code; ``lifelike=True`` makes one of the same type, script
and format instead (digits for digits, letters for letters of the same case, names of the same gender ending).

Defined results: null text gives no entity and stays null; empty text stays empty; documents without
any entity come out unchanged.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left

import ahocorasick
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.session import spread

#: Distinct name words that are sent to the tasks; more are refused.
LEXICON_LIMIT = 1_000_000
#: Times that a word must stand as a name before it counts as one outside of such places.
LEAST_SEEN = 2
#: Lifelike surrogates tried before an entity gets a placeholder, and entities not at their first one that are sent to the tasks.
ATTEMPTS, CLASH_LIMIT = 16, 1_000_000

_W = r"[^\W\d_]+(?:['’ʼ\-‑][^\W\d_]+)*"
_CAP = r"(?=[^\W\d_a-zà-öø-ÿ])" + _W

# ---------------------------------------------------------------- e-mail
_EMAIL = re.compile(r"(?<![\w.+%@\-])(?P<local>[^\W_][\w.+\-']*|[^\W_])(?:@|%40|＠)(?P<host>(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,})(?![\w@])", re.I)
_EMAIL_QUERY = re.compile(r"(?<==)(?P<local>[^\W_](?:[\w.\-]|%2B|\+)*)(?:@|%40)(?P<host>(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,})(?![\w@])", re.I)
_EMAIL_SPELT = re.compile(
    r"(?<![\w.+@\-])(?P<local>[^\W_][\w.+\-]*)[ \t]*(?:[(\[{<][ \t]*(?:at|@|ät|arroba|chez)[ \t]*[)\]}>]|[ \t](?:at|AT|arroba)[ \t])[ \t]*(?P<host>[^\W_][\w-]*(?:[ \t]*(?:[(\[{<][ \t]*(?:dot|\.|punkt|point|punto)[ \t]*[)\]}>]|[ \t](?:dot|DOT|punkt|point|punto)[ \t]|\.(?=\w))[ \t]*[^\W_][\w-]*)+)",
    re.I,
)

# ---------------------------------------------------------------- phone
_EXT = r"(?:,?[ \t]*(?:ext\.?|extension|x|Durchwahl|poste)[ \t]*\d{1,5})?"
_PHONE = re.compile(
    rf"(?<![\w.+\-/:=#])(?:(?:\+|00)[1-9]\d{{0,2}}(?:[ .\-/]|[ ]?\(0\)[ ]?)?(?:\(\d{{1,4}}\)[ .\-]?)?\d{{1,6}}(?:[ .\-/]\d{{2,9}}){{0,6}}|(?:\(\d{{3}}\)[ ]?|\d{{3}}[-. ])\d{{3}}[-. ]\d{{4}}){_EXT}(?![\w]|[.\-]\d)"
)
_PHONE_NEAR = re.compile(rf"(?i)(?:\b(?:tel(?:efon|ephone|éfono)?|phone|fon|fax|mobile|cell|mobil|handy|call|ruf|tél|móvil|appelez)\b[^\w\n]{{0,4}}(?:(?:no|nr|number|n°)\.?[ :]*)?)(?P<n>\(?0\d{{1,5}}\)?(?:[ .\-/]\d{{2,9}}){{1,5}}|0\d{{7,12}}|\d{{7,12}}){_EXT}(?![\w]|[.\-]\d)")

# ---------------------------------------------------------------- identity numbers
_ID_LABEL = (
    r"(?:ssn|social[ \-]security(?:[ \-](?:number|no\.?|nr\.?|#))?|passport(?:[ \-](?:number|no\.?|nr\.?|#))?|reisepass(?:[ \-]?(?:nummer|nr\.?))?|personalausweis(?:[ \-]?(?:nummer|nr\.?))?|pasaporte|passeport"
    r"|tax[ \-]?(?:id(?:entification)?|payer)(?:[ \-](?:number|no\.?))?|tin|steuer[ \-]?(?:id(?:entifikationsnummer|nr\.?|[ \-]?nummer)?|nummer)|sozialversicherungsnummer|num[ée]ro[ \-]de[ \-]s[ée]curit[ée][ \-]sociale|nif|nie|dni|nir"
    r"|national[ \-]?(?:id|identity|insurance)(?:[ \-](?:card|number|no\.?))?|id[ \-]?card(?:[ \-](?:number|no\.?))?|identity[ \-](?:card|number)(?:[ \-](?:number|no\.?))?|driver'?s[ \-]licen[cs]e(?:[ \-](?:number|no\.?))?|identification[ \-]number|personnummer|bsn|pesel|cpf|aadhaar|curp)"
)
_ID = re.compile(
    rf"(?i)(?<![\w]){_ID_LABEL}[\"']?[ \t]*(?:[:=#]|no\.?|nr\.?|n°|number|is|ist|est|es)?[ \t]*(?:[:=#][ \t]*)?[\"']?(?P<n>(?=[A-Z0-9 .\-/]*\d[A-Z0-9 .\-/]*\d)[A-Z]{{0,3}}[ \-]?\d[\d]*(?:[ .\-/]?\d+)*(?:[ \-]?[A-Z](?![A-Za-z]))?)(?![\w]|[\-/]\d)"
)
_SSN = re.compile(r"(?<![\w.\-/+])\d{3}-\d{2}-\d{4}(?![\w]|[.\-/]\d)")

# ---------------------------------------------------------------- street addresses
_TYPE = r"(?:Street|Avenue|Road|Lane|Row|Court|Drive|Boulevard|Square|Terrace|Place|Way|Crescent|Close|Gardens|Grove|Hill|Mews|Parade|Quay|Walk|Alley|Circle|Highway|Parkway|Pike|Rise|St|Ave|Rd|Ln|Dr|Blvd|Sq|Ct|Ter|Pl|Hwy|Pkwy|Cres)\b\.?"
_UNIT = r"(?:,?[ \t]+(?:Apt|Apartment|Unit|Suite|Ste|Flat|Floor|Room|Rm|Bldg|Building|#)\.?[ \t]*#?[\w-]{1,6})?"
_ZIP = r"(?:[A-Z]{1,2}\d[A-Z\d]?[ ]\d[A-Z]{2}|\d{4,5}(?:-\d{4})?)"
_TOWN = rf"[^\W\d_a-z][\w'’\-]+(?:[ \t]+[^\W\d_a-z][\w'’\-]+){{0,2}}"
_TAIL = rf"(?:,?[ \t\n]+(?:{_ZIP}[ \t]+{_TOWN}|{_TOWN}(?:,?[ \t]+[A-Z]{{2}})?(?:,?[ \t]+{_ZIP})?))?"
_STREET_EN = rf"\d{{1,5}}(?:[ ]?[A-Za-z])?(?:[-/]\d{{1,4}})?,?[ \t]+(?:(?:North|South|East|West|N|S|E|W|Old|New|Upper|Lower|Saint|St)\.?[ \t]+)?(?:[^\W\d_a-z][\w'’\-]*[ \t]+){{1,3}}{_TYPE}"
_STREET_FR = r"\d{1,4}(?:[ ]?(?:bis|ter|quater|[A-Za-z]))?,?[ \t]+(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours|passage|square|faubourg)[ \t]+(?:(?:de la|de l['’]|des|du|de|d['’]|à la|aux|au|le|la|les)[ \t]*)?[^\W\d_][\w'’\-]+(?:[ \t]+[^\W\d_a-z][\w'’\-]+){0,2}"
_STREET_DE = r"(?:[^\W\d_a-z][\w\-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|stieg|chaussee|graben|markt|hof|steig|pfad|berg)|(?:[^\W\d_a-z][\w\-]*[ \t]+)(?:Straße|Strasse|Weg|Gasse|Allee|Platz|Ring|Damm|Ufer))[ \t]+\d{1,4}(?:[ ]?[a-zA-Z]\b)?(?:[-/]\d{1,3})?"
_STREET_ES = r"(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Carrera|Carretera|Travesía|Ronda|Rambla|Glorieta)[ \t]+(?:(?:de las|de los|de la|del|de|las|los|la|el)[ \t]+)?[^\W\d_][\w'’\-]+(?:[ \t]+(?:(?:de|del|la)[ \t]+)*[^\W\d_a-z][\w'’\-]+){0,3},?[ \t]+(?:n[º°.]?[ \t]*)?\d{1,4}(?:[ ]?[A-Za-z]\b)?"
_ADDRESS = re.compile(rf"(?<![\w.\-/#])(?:{_STREET_EN}|{_STREET_FR}){_UNIT}{_TAIL}|(?<![\w.\-/#])(?:{_STREET_DE}|{_STREET_ES}){_UNIT}{_TAIL}")

# ---------------------------------------------------------------- names
_TITLE = r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Miss|Mx|Sir|Herr|Frau|Mme|Mlle|M|Sr|Sra|Srta|Don|Doña|Ing|Dipl)\.?[ \t]+)*"
_ID_HINT = rf"(?i:{_ID_LABEL})"
#: Places in which only a name stands: g the given, f the family name.
_PLACES = [
    re.compile(rf"(?m)^[ \t>*-]*(?:Author|Committer|Signed-off-by|Reviewed-by|Co-authored-by|Tested-by|Acked-by|Reported-by|Suggested-by|From|Cc|To)[ \t]*:[ \t]*{_TITLE}(?P<g>{_W})[ \t]+(?P<f>{_W})(?=[ \t]*(?:<|$))"),
    re.compile(rf"(?:Author|Committer|Signed-off-by|Reviewed-by|Co-authored-by)[ \t]*:[ \t]*{_TITLE}(?P<g>{_W})[ \t]+(?P<f>{_W})(?=[ \t]*<)"),
    re.compile(rf"(?i:\bassignee|\breviewer|\bowner)[ \t]*:[ \t]*(?P<f>{_W}),[ \t]+(?P<g>{_W})(?=[ \t]*(?:$|\n|;))"),
    re.compile(rf'"(?:user|name|author|owner|full_name|contact)"[ \t]*:[ \t]*"{_TITLE}(?P<g>{_W})[ \t]+(?P<f>{_W})"'),
    re.compile(rf"\|[ \t]*{_TITLE}(?P<g>{_CAP})[ \t]+(?P<f>{_CAP})[ \t]*\|[ \t]*(?=[+(]?\d|\S+@)"),
    re.compile(rf"\b(?P<g>{_CAP})[ \t]+(?P<f>{_CAP}),[ \t]+(?={_ID_HINT}[^\w]|(?i:national|id card))"),
    re.compile(rf"(?m)^--[ \t]*\n{_TITLE}(?P<g>{_CAP})[ \t]+(?P<f>{_CAP})[ \t]*$"),
    re.compile(rf"\b(?:Dr|Prof|Mr|Mrs|Ms|Herr|Frau|Mme)\.?[ \t]+(?P<g>{_CAP})[ \t]+(?P<f>{_CAP})\b"),
]
#: A phone number in brackets, and the name that may stand before it.
_BRACKETED = re.compile(r"[ \t]\((?=[+(]?\d[\d ().\-]{6,})")
_BEFORE = re.compile(rf"(?<![^\W\d_])(?P<g>{_CAP})[ \t]+(?P<f>{_CAP})[ \t]*\Z")
_TOKEN = re.compile(_W)
#: What the lower-case text must hold for a pattern to be worth a search.
_ID_WORDS = "ssn social passport reisepass personalausweis pasaporte passeport tax tin steuer sozialvers curit nif nie dni nir national card identi driver personnummer bsn pesel cpf aadhaar curp".split()
_PHONE_WORDS = ["tel", "tél", "phone", "fon", "fax", "mobil", "cell", "handy", "call", "ruf", "móvil", "appelez"]
#: What every spelt-out e-mail holds: a sign in brackets, or one between blanks and a spelt-out or bracketed dot.
_AT_BRACKET = re.compile(r"[(\[{<][ \t]*(?:at|@|ät|arroba|chez)[ \t]*[)\]}>]", re.I)
_AT_BLANK = re.compile(r"[ \t](?:at|arroba)[ \t]", re.I)
_DOT_SPELT = re.compile(r"[(\[{<][ \t]*(?:dot|\.|punkt|point|punto)[ \t]*[)\]}>]|[ \t](?:dot|punkt|point|punto)[ \t]", re.I)
_BETWEEN = re.compile(r"(?:[ \t\u00a0\u202f]+|,[ \t\u00a0\u202f]+|[ \t]*\n[ \t]*|,[ \t]*\n[ \t]*)\Z")


def key_of(word: str) -> str:
    return unicodedata.normalize("NFC", word).replace("’", "'").replace("ʼ", "'").replace("‑", "-").lower()


def _placed(text: str) -> list[re.Match]:
    """Given and family names that stand in places of names in a text."""
    found = [m for p in _PLACES for m in p.finditer(text)]
    found += [m for b in _BRACKETED.finditer(text) if (m := _BEFORE.search(text, max(0, b.start() - 80), b.start()))]
    return [m for m in found if not (m["g"][0].islower() or m["f"][0].islower() or len(m["g"]) < 2 or len(m["f"]) < 2)]


def name_places(text: str) -> set[tuple[str, str]]:
    """(role, word) of the words that stand in places of names in a text; role g or f."""
    return {(r, key_of(m[r])) for m in _placed(text) for r in "gf"}


_AUTOMATA: dict[bytes, ahocorasick.Automaton] = {}


class Names:
    """Given and family names; finds pairs of them with an automaton over all of them."""

    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = given, family
        # the automaton is made once in a worker, whatever number of tasks bring these names
        self.key = hashlib.blake2b("\n".join([*sorted(given), "", *sorted(family)]).encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def find(self, text: str) -> list[tuple[int, int]]:
        given, family = self.given, self.family
        if not given or not family:
            return []
        automaton = _AUTOMATA.get(self.key)
        if automaton is None:
            automaton = ahocorasick.Automaton()
            for w in given | family:
                automaton.add_word(w, w)
            automaton.make_automaton()
            _AUTOMATA.clear()
            _AUTOMATA[self.key] = automaton
        low = text.lower() if text.isascii() else "".join(map(_folded, text))
        hits, n = [], len(text)
        for last, w in automaton.iter_long(low):
            a, e = last - len(w) + 1, last + 1
            if (a and (text[a - 1].isalnum() or text[a - 1] in "_-'’" and a > 1 and text[a - 2].isalnum())) or (e < n and (text[e].isalnum() or text[e] in "_-'’" and e + 1 < n and text[e + 1].isalpha() and text[e : e + 2].lower() not in ("'s", "’s"))):
                continue
            hits.append((a, e, w))
        out, i = [], 0
        while i + 1 < len(hits):
            (a, b, k), (c, d, k2) = hits[i], hits[i + 1]
            gap = text[b:c]
            if len(gap) <= 6 and _BETWEEN.match(gap) and ((k in given and k2 in family and "," not in gap) or (k in family and k2 in given)):
                if text[a].islower() == text[c].islower():
                    out.append((a, d))
                    i += 2
                    continue
            i += 1
        return out


def _folded(c: str) -> str:
    """One character in the form of the lexicon, so that offsets stay."""
    x = c.lower()
    return ("'" if c in "’ʼ" else "-" if c == "‑" else c) if len(x) != 1 or c in "’ʼ‑" else x


def entities(text: str, names: Names | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities of a text, sorted and apart from each other; an earlier kind wins over a later one."""
    found: list[tuple[int, int, str]] = []  # sorted, and apart from each other

    def add(a: int, b: int, kind: str) -> None:
        i = bisect_left(found, (a, b, ""))
        if (i == 0 or found[i - 1][1] <= a) and (i == len(found) or found[i][0] >= b):
            found.insert(i, (a, b, kind))

    low = text.lower()
    if "@" in text or "%40" in text or "＠" in text:
        for p in (_EMAIL, _EMAIL_QUERY):
            for m in p.finditer(text):
                a, b = m.start(), m.end()
                if text[max(0, a - 3) : a].endswith(("://", "/")) or (text[b : b + 1] == ":" and re.match(r":[\w~./-]", text[b : b + 2])) or (m["local"].lower() == "git" and text[b : b + 1] in ":/"):
                    continue  # a clone URL
                if re.search(r"\w+://\S*\Z", text[max(0, a - 80) : a]) and "=" not in text[max(0, a - 80) : a]:
                    continue
                add(a, b, "email")
    if _AT_BRACKET.search(text) or (_DOT_SPELT.search(text) and _AT_BLANK.search(text)):
        for m in _EMAIL_SPELT.finditer(text):
            marked = re.search(r"[(\[{<][ \t]*(?:at|@|ät|arroba|chez)", m[0], re.I)
            dots = re.search(r"(?:dot|punkt|point|punto|\.)", m["host"], re.I)
            if dots and (marked or re.search(r"[ \t](?:dot|DOT|punkt|punto)[ \t]|[(\[{<]", m["host"])):
                add(m.start(), m.end(), "email")
    if re.search(r"\d", text):
        for m in _ID.finditer(text) if any(x in low for x in _ID_WORDS) else ():
            n = m["n"].rstrip(" .-/")
            if 5 <= sum(c.isdigit() for c in n) <= 18:
                add(m.start("n"), m.start("n") + len(n), "id_number")
        for m in _SSN.finditer(text):
            add(m.start(), m.end(), "id_number")
        for m in _ADDRESS.finditer(text):
            before = text[max(0, m.start() - 12) : m.start()].lower()
            if re.search(r"\b(?:route|level|line|step|build|version|depth)\s\Z", before):
                continue
            add(m.start(), m.end(), "address")
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in re.split(r"(?i)ext|x|durchwahl|poste", m[0])[0]) <= 15:
                add(m.start(), m.end(), "phone")
        for m in _PHONE_NEAR.finditer(text) if any(x in low for x in _PHONE_WORDS) else ():
            add(m.start("n"), m.end(), "phone")
    if names:
        for a, b in names.find(text):
            add(a, b, "name")
    for m in _placed(text):
        add(min(m.start("g"), m.start("f")), max(m.end("g"), m.end("f")), "name")
    return found


# ---------------------------------------------------------------- surrogates
_PLACEHOLDER = {"email": "EMAIL", "phone": "PHONE", "id_number": "ID", "address": "ADDRESS", "name": "NAME"}


def canonical(entity: str, kind: str) -> str:
    """What makes two mentions the same entity: case, spacing and the order of names do not count."""
    if kind == "name":
        return " ".join(sorted(key_of(w) for w in _TOKEN.findall(entity)))
    if kind in ("phone", "id_number"):
        return re.sub(r"\W", "", entity).lower()
    if kind == "email":
        s = re.sub(r"[ \t]*(?:[(\[{<][ \t]*(?:at|@)[ \t]*[)\]}>]|[ \t]at[ \t]|%40)[ \t]*", "@", entity, flags=re.I)
        s = re.sub(r"[ \t]*(?:[(\[{<][ \t]*(?:dot|\.)[ \t]*[)\]}>]|[ \t]dot[ \t])[ \t]*", ".", s, flags=re.I)
        return s.lower()
    return re.sub(r"\W+", " ", entity).strip().lower()


def keyed(secret: bytes, kind: str, canon: str, attempt: int = 0) -> bytes:
    return hmac.new(secret, f"{kind}\x1f{canon}\x1f{attempt}".encode(), hashlib.sha256).digest()


def placeholder(kind: str, digest: bytes, whole: bool = False) -> str:
    return f"[{_PLACEHOLDER[kind]}_{(digest if whole else digest[:6]).hex()}]"


def surrogate(entity: str, kind: str, canon: str, key: bytes, attempt: int = 0, lifelike: bool = False) -> str:
    """The surrogate of an entity; of a later attempt, a placeholder has the whole code, as has a lifelike one that could not be told from others."""
    d = keyed(key, kind, canon, attempt)
    return realistic(entity, d) if lifelike and attempt < ATTEMPTS else placeholder(kind, d, attempt > 0)


_VOWEL, _CONS = "aeiou", "bcdfghklmnprstvz"


def realistic(entity: str, digest: bytes) -> str:
    """A made-up entity of the same form: digits become digits, letters letters of the same case and script, the last letter of a word stays, so
    that the ending that shows the gender of a name does."""
    stream = int.from_bytes(digest + hashlib.sha256(digest).digest(), "big")
    out = []
    for i, c in enumerate(entity):
        if c.isdigit():
            stream, r = divmod(stream, 10)
            out.append(str(r))
        elif c.isalpha() and c.isascii() and i + 1 < len(entity) and entity[i + 1].isalnum():
            pool = _VOWEL if c.lower() in _VOWEL else _CONS
            stream, r = divmod(stream, len(pool))
            out.append(pool[r].upper() if c.isupper() else pool[r])
        elif c.isalpha() and not c.isascii():
            base = ord(c) & ~0x0F
            stream, r = divmod(stream, 16)
            n = chr(base + r)
            out.append(n if n.isalpha() and n.isupper() == c.isupper() else c)
        else:
            out.append(c)
        if stream < 1 << 16:
            digest = hashlib.sha256(digest + b"+").digest()
            stream = int.from_bytes(digest, "big")
    return "".join(out)


# ---------------------------------------------------------------- Spark
def name_lexicon(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text", least: int = LEAST_SEEN) -> DataFrame:
    """(role, word): given (g) and family (f) names, learned from all documents; counted in each task before the shuffle."""
    rows = spread(documents.select(F.col(text_col).alias("__text"))).filter(F.col("__text").isNotNull())

    def run(batches):
        seen: dict[tuple[str, str], int] = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                for k in name_places(text):
                    seen[k] = seen.get(k, 0) + 1
            if len(seen) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in seen]), pa.array([w for _, w in seen]), pa.array(list(seen.values()), pa.int64())], names=["role", "word", "n"])
                seen = {}
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in seen], pa.string()), pa.array([w for _, w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["role", "word", "n"])

    return rows.mapInArrow(run, "role string, word string, n long").groupBy("role", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("role", "word")


def learned_names(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text", least: int = LEAST_SEEN, limit: int = LEXICON_LIMIT) -> Names:
    """The lexicon as an object for the tasks.  Its size is checked: names of people grow far slower than documents, and past ``limit`` words
    only those of the highest counts could be sent, which is refused rather than done silently."""
    got = name_lexicon(documents, doc_col, text_col, least).limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} names: use a larger least or limit")
    return Names({r.word for r in got if r.role == "g"}, {r.word for r in got if r.role == "f"})


def personal_entities(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text", names: Names | None = None, with_text: bool = False) -> DataFrame:
    """(``doc_col``, start_pos, end_pos, pii_type[, entity, canon]): one row per occurrence, positions from 1 in code points."""
    names = names or learned_names(documents, doc_col, text_col)
    rows = spread(documents.select(F.col(doc_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))).filter(F.col("__text").isNotNull())
    schema = pa.schema([("__id", pa.int64()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("pii_type", pa.string())] + ([("entity", pa.string()), ("canon", pa.string())] if with_text else []))

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in schema.names]
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for a, e, k in entities(text, names):
                    for c, v in zip(cols, (i, a + 1, e + 1, k, *((text[a:e], canonical(text[a:e], k)) if with_text else ()))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return rows.mapInArrow(run, f"__id long, start_pos long, end_pos long, pii_type string{', entity string, canon string' if with_text else ''}").withColumnRenamed("__id", doc_col)


def _forms(found: DataFrame, doc_col: str, lifelike: bool) -> DataFrame:
    """Distinct entities, and their forms if these show in surrogates."""
    keys = ["pii_type", "canon", *(["entity"] if lifelike else [])]
    got = found.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.countDistinct(doc_col).alias("documents"))
    return got if lifelike else got.withColumn("entity", F.col("canon"))


def _with_surrogates(forms: DataFrame, key: bytes, attempts: dict[tuple[str, str], int], lifelike: bool) -> DataFrame:
    """``forms`` with attempt, surrogate, and same: what makes two surrogates the same."""
    names = forms.columns

    def run(batches):
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("pii_type", "canon", "entity"))))
            tried = [attempts.get((k, c), 0) for k, c, _ in rows]
            made = [surrogate(e, k, c, key, n, lifelike) for (k, c, e), n in zip(rows, tried)]
            same = [canonical(s, k) if lifelike and n < ATTEMPTS else s for s, (k, _, _), n in zip(made, rows, tried)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tried, pa.int32()), pa.array(made, pa.string()), pa.array(same, pa.string())], names=[*names, "attempt", "surrogate", "same"])

    return forms.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in forms.dtypes), "attempt int, surrogate string, same string"]))


def _attempts(forms: DataFrame, key: bytes, lifelike: bool) -> dict[tuple[str, str], int]:
    """Attempts of the entities whose first surrogate is another's; of those that share one, the least tried and then the first keeps it."""
    attempts: dict[tuple[str, str], int] = {}
    while True:
        made = _with_surrogates(forms, key, dict(attempts), lifelike)
        shared = made.groupBy("pii_type", "same").agg(F.min_by("canon", F.struct("attempt", "canon")).alias("keeps"), F.min("canon").alias("a"), F.max("canon").alias("b")).filter("a <> b")
        lost = made.join(shared, ["pii_type", "same"]).filter("canon <> keeps").select("pii_type", "canon").distinct().limit(CLASH_LIMIT + 1).collect()
        if not lost:
            return attempts
        for r in lost:
            attempts[r.pii_type, r.canon] = attempts.get((r.pii_type, r.canon), 0) + 1
        if len(attempts) > CLASH_LIMIT:
            raise ValueError(f"more than {CLASH_LIMIT} entities share surrogates: use placeholders")


def surrogate_table(found: DataFrame, secret: str, doc_col: str = "doc_id", lifelike: bool = False) -> DataFrame:
    """(pii_type, canon[, entity], occurrences, documents, surrogate): one row per distinct entity of the corpus, if lifelike per form of it.

    The surrogates are those of ``pseudonymised``: such that two entities share are made anew for all but one of them, until none is shared.
    """
    forms = _forms(found, doc_col, lifelike).persist(StorageLevel.MEMORY_AND_DISK)
    made = _with_surrogates(forms, secret.encode(), _attempts(forms, secret.encode(), lifelike), lifelike)
    return made.select("pii_type", "canon", *(["entity"] if lifelike else []), "occurrences", "documents", "surrogate")


def pseudonymised(documents: DataFrame, secret: str, doc_col: str = "doc_id", text_col: str = "text", names: Names | None = None, lifelike: bool = False) -> DataFrame:
    """(``doc_col``, entities, ``text_col``): every row; each entity replaced by its surrogate, the rest of the text unchanged."""
    names = names or learned_names(documents, doc_col, text_col)
    key = secret.encode()
    rows = documents.select(F.col(doc_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    spans = "array<struct<a: int, b: int, pii_type: string, canon: string, entity: string>>"
    span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("pii_type", pa.string()), ("canon", pa.string()), ("entity", pa.string())]))

    def find(batches):
        for b in batches:
            got = [[{"a": a, "b": e, "pii_type": k, "canon": canonical(t[a:e], k), "entity": t[a:e]} for a, e, k in entities(t, names)] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, span)], names=["__id", "__text", "spans"])

    # kept, as entities must be known over the whole corpus before the first is replaced
    marked = rows.mapInArrow(find, f"__id long, __text string, spans {spans}").persist(StorageLevel.MEMORY_AND_DISK)
    forms = _forms(marked.select("__id", F.explode("spans").alias("s")).select("__id", "s.*"), "__id", lifelike)
    attempts = _attempts(forms, key, lifelike)

    def replace(batches):
        for b in batches:
            texts, counts = [], []
            for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                out, at = [], 0
                for s in found:
                    k, c = s["pii_type"], s["canon"]
                    out += [t[at : s["a"]], surrogate(s["entity"], k, c, key, attempts.get((k, c), 0), lifelike)]
                    at = s["b"]
                texts.append("".join([*out, t[at:]]) if t else t)
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int32()), pa.array(texts, pa.string())], names=["__id", "entities", "__text"])

    return marked.mapInArrow(replace, "__id long, entities int, __text string").withColumnRenamed("__id", doc_col).withColumnRenamed("__text", text_col)
