"""Local grammars over token shapes.

A bracket group, or a whole file, is checked only by what stands directly in it: the
groups inside it have been checked before and each is one character that names the roles
it can fill.  Everything here is a pattern over these short strings, and each distinct
string is judged once per worker process.
"""

from __future__ import annotations

import re
from functools import lru_cache

from gristmill.llm.shapes import BAD

# Roles of groups, as bits: (...) 1 values, 2 parameters, 4 loop head, 8 type or result list, 16 declarations
PAREN, BRACKET, BRACE = 0xE000, 0xE100, 0xE200
# [...] 1 values, 2 empty or a size; {...} 1 block, 2 values, 4 class body, 8 switch body, 16 enum body, 32 interface or struct, 64 names to import
NBITS = {PAREN: 5, BRACKET: 2, BRACE: 7}


def code(mask: int, bits: int) -> int:
    """Place of a set of roles among the characters of its kind of bracket: the first role has the highest bit, so that the roles asked for most are few ranges."""
    return int(f"{mask:0{bits}b}"[::-1], 2)


def ranges(base: int, bit: int, bits: int) -> str:
    """Pattern of the characters whose roles hold one; ranges, as long lists of characters are slow to compile."""
    low = code(bit, bits)
    return "[" + "".join(f"{chr(base + h + low)}-{chr(base + h + 2 * low - 1)}" for h in range(0, 1 << bits, 2 * low)) + "]"


def group(base: int, bit: int) -> str:
    return ranges(base, bit, NBITS[base])


PE, PD, PH, PT, PG = (group(PAREN, 1 << i) for i in range(5))
KE, K0 = group(BRACKET, 1), group(BRACKET, 2)
QB, QO, QC, QS, QE, QI, QM = (group(BRACE, 1 << i) for i in range(7))
ANYP, ANYK, ANYQ = f"[{chr(PAREN)}-{chr(PAREN + 255)}]", f"[{chr(BRACKET)}-{chr(BRACKET + 255)}]", f"[{chr(BRACE)}-{chr(BRACE + 255)}]"
P_SET, K_SET, Q_SET = ANYP[1:-1], ANYK[1:-1], ANYQ[1:-1]


class Grammar:
    """Patterns of one language; ``roles`` maps a role of a group to the pattern of its content."""

    def __init__(self, lang: str, paren: dict[int, str], bracket: dict[int, str], brace: dict[int, str], top: str, prepare):
        self.lang, self.prepare = lang, prepare
        self.of = {"(": (PAREN, [(b, re.compile(p)) for b, p in paren.items()]), "[": (BRACKET, [(b, re.compile(p)) for b, p in bracket.items()]), "{": (BRACE, [(b, re.compile(p)) for b, p in brace.items()])}
        self.top = re.compile(top)
        self.close = lru_cache(maxsize=200_000)(self._close)
        self.whole = lru_cache(maxsize=50_000)(self._whole)

    def _close(self, text: str) -> str:
        """The character for a balanced group whose inner groups are closed; BAD if its content fits no role."""
        inner = self.prepare(text[1:-1], text[0])
        base, roles = self.of[text[0]]
        mask = sum(bit for bit, p in roles if p.fullmatch(inner))
        return chr(base + code(mask, NBITS[base])) if mask else BAD

    def _whole(self, text: str) -> bool:
        return bool(self.top.fullmatch(self.prepare(text, "")))


def listed(x: str) -> str:
    return rf"(?:{x}(?:,{x})*+,?)?"


# ---------------------------------------------------------------- JavaScript and TypeScript
def _script(ts: bool) -> Grammar:
    word = "[aAtFCXLIHEDTcfSkdRByYNbixgrJ]"
    ty1 = rf"(?:(?:[ay]n?)*(?:a(?:\.{word})*|[st0y]|p0|NPw)|(?:N?{ANYP}w)?(?:{ANYP}|{ANYK}|{ANYQ}|a(?:\.{word})*|[st0y]))(?:{ANYK})*"
    ty = rf"(?:[|&]?{ty1}(?:(?:[|&]|X|ba?|w|\?|:|aa)n?{ty1})*)"
    ann = rf"(?:[!?]?:{ty})?" if ts else ""
    ret = rf"(?::{ty})?" if ts else ""
    fun = rf"A?F\*?a?{PD}{ret}n?{QB}"
    cname = "(?:a(?=[aX" + Q_SET + "n]))?" if ts else "a?"  # the name of a class may be left out
    cls = rf"(?:@a(?:\.a)*{PE}?n*)*C{cname}(?:Xn?[at](?:\.{word}|{PE})*)?" + (rf"(?:a{ty}(?:,{ty})*)?" if ts else "") + f"n?{QC}"
    arrow = rf"A?(?:a|A|{PD}{ret})w"
    post = rf"(?:\.{word}|\.{KE}|\.{PE}|{PE}|{KE}|s|q" + ("|!(?![=])" if ts else "") + ")"
    opnd = rf"(?:{arrow}n?{QB}|(?:{arrow})*+(?:{fun}|{cls}|[aA0st]|{PE}|{KE}|{QO}|i(?={ANYP}|\.)|N\.a))"
    una = rf"(?:[!~pqyN]|{arrow}(?!n?{QB})" + (rf"|<{ty}>" if ts else "") + r"|Y\*?(?=[^;,n)]))"
    unit = rf"(?:{una})*+{opnd}{post}*+" + (rf"(?:a(?:{ty1})(?:[|&]{ty1})*)?+" if ts else "")
    binop = r"(?:>>>|>>|[b=p<>*&|])" if ts else r"[b=p<>*&]"
    e1 = rf"(?:(?:{unit}|Y)(?:{binop}{unit})*+)"
    e = rf"(?:{e1}(?:\?{e1}(?:\?{e1})*+:{e1}(?:[?:]{e1})*+)?+)"
    es = rf"{e}(?:,{e})*+"
    end = r"(?:;|n+|\Z)"
    bind = rf"(?:[aA]|{KE}|{QO}|{QM})"
    decl = rf"L{bind}{ann}(?:=(?!=){e})?(?:,{bind}{ann}(?:=(?!=){e})?)*+"
    names = rf"(?:a|A|{QM}|\*aa)(?:,(?:{QM}|\*aa))?"
    tsdecl = rf"|(?:a)*(?:aa(?:Xn?{ty}(?:,{ty})*)?n?{QI}n?|a[as](?:\.a)*n?{QB}|aa={ty}{end}|L?Ja?n?{QE}|A?F\*?a{PD}{ret}{end}|{decl}{end}|{cls}|{fun})" if ts else ""
    stmt = (
        rf"(?:;|n|{QB}|I{PE}n*|H(?:{PE}|{PH})n*|Ha{PH}n*|E(?:n*)|D(?:n*)|a:n*|Tn?{QB}(?:n?c{PD}?n?{QB}n?fn?{QB}|n?c{PD}?n?{QB}|n?fn?{QB})|S{PE}n?{QS}"
        rf"|{decl}{end}|A?F\*?a{PD}{ret}n?{QB}|{cls}|R{es}{end}|R{end}|Ba?{end}|g{end}"
        rf"|i(?:a)?(?:s|{names}as)(?:a{QO})?{end}|x(?:d(?:{fun}|{cls}|{e}{end})|a?{QM}(?:as)?{end}|\*(?:aa)?as{end}|(?={'[LFCAaJ@]' if ts else '[LFCA@]'})n?)" + tsdecl + rf"|(?![FCL]|{ANYQ}){es}{end})"
    )
    key = rf"(?:{word}|s|0|{KE})"
    item = rf"n*(?:e{e}|{key}:n*{e}|(?:[aA]|\*)*{key}{PD}{ret}n?{QB}|[aAtr](?:={e})?)n*"
    member = rf"(?:;|n|@a(?:\.a)*{PE}?n*|(?:[aA]|\*)*{key}[!?]?{PD}{ret}n?(?:{QB}{'|' + end if ts else ''})|a{QB}|(?:a)*{key}{ann}(?:={e})?{end})"
    param = rf"n*(?:@a{PE}?)*(?:e)?" + ("(?:a(?=[aAt" + K_SET + Q_SET + "]))*" if ts else "") + rf"(?:[aA{'t' if ts else ''}]|{KE}|{QO}|{QM})" + ("\\??" if ts else "") + ann + rf"(?:={e})?n*"
    case = rf"(?:k{e1}:n*|d:n*|{stmt})*+"
    spec = rf"n*(?:{word}|s)(?:a(?:{word}|s))?(?:{word}(?:a{word})?)?n*"
    paren = {1: listed(rf"n*e?{e}n*"), 2: listed(param), 4: rf"(?:{decl}|{es})?;n*(?:{es})?;n*(?:{es})?|L{bind}(?:a|b){e}|[aA](?:\.a)*(?:a|b){e}"}
    if ts:
        paren[8] = rf"n*{ty}n*"
    iface = rf"(?:;|,|n|(?:a(?=[a{K_SET}]))*(?:{word}|s|0|{ANYK})?\??(?:{ANYP})?(?::{ty})?(?:;|,|n|\Z))*+"
    bracket = {1: rf"n*(?:(?:e?{e}n*)?(?:,n*(?:e?{e}n*)?)*+)"}
    if ts:
        bracket |= {2: rf"|{ty}(?:,{ty})*,?|a:{ty}|ab{ty}"}
    brace = {1: rf"(?:{stmt})*+", 2: listed(item) + "n*", 4: rf"(?:{member})*+", 8: case, 16: listed(rf"n*(?:a|s)(?:={e})?n*") + "n*", 64: listed(spec) + "n*"}
    if ts:
        brace[32] = iface
    cont = re.compile(r"n+(?=[.b=p?:w,*&<>;|Xh])|(?<=[.=b?:w,*&<>;(~!|eNyLXiFCAxkDETcf])n+|(?<=p)n+|^n+" if ts else r"n+(?=[.b=p?:w,*&<>;X])|(?<=[.=b?:w,*&<>;(~!eNyLXiFCAxkDETcf])n+|(?<=p)n+|^n+")
    generic = re.compile(rf"(?<=[aFA])<[a.,st0y|&?:=bXwn{P_SET}{K_SET}{Q_SET}]*>(?=[^a0s]|\Z)|^<[aX,=.|&]*>(?={ANYP})|(?<=Xa)<[a.,st0y|&?:=bXwn{P_SET}{K_SET}{Q_SET}]*>(?=a)")

    def prepare(s: str, kind: str) -> str:
        s = cont.sub("", s)
        if kind == "(":
            s = s.replace("n", "")
        if ts and "<" in s:
            while True:
                t = generic.sub("", s)
                if t == s:
                    break
                s = t
        return s

    return Grammar("ts" if ts else "js", paren, bracket, brace, rf"(?:{stmt})*+", prepare)


# ---------------------------------------------------------------- Java
def _java() -> Grammar:
    ann = rf"@a(?:\.a)*{ANYP}?"
    mods = rf"(?:m|d|y|{ann}|a(?=C))*+"
    ty = rf"(?:{ann})*(?:a(?:\.{ann}|\.a)*|v)(?:{K0})*+"
    arrow = rf"(?:a|{PD}|{PE})w"
    post = rf"(?:\.(?:{ANYP})?[atNCy]|{PE}|{KE}|q)"
    opnd = rf"(?:{arrow}{QB}|N{ty}(?:{PE}{QC}?|{ANYK}*{QO}?)|[a0st]|v(?:{K0})*\.[CN]|a(?:\.a)*{K0}+\.[CN]|{PE}|S{PE}{QS})"
    una = rf"(?:[!~pq]|{arrow}(?!{QB})|{PT}(?=[a0st!~vNS{P_SET}])|{PT}(?=[pq]))"
    unit = rf"(?:{una})*+{opnd}{post}*+(?:om?(?:{ty}a?|a{PD}a?))?+"
    e1 = rf"(?:{unit}(?:(?:>>>|>>|[b=p<>*&|]){unit})*+)"
    e = rf"(?:{e1}(?:\?{e1}(?:\?{e1})*+:{e1}(?:[?:]{e1})*+)?+)"
    es = rf"{e}(?:,{e})*+"
    init = rf"(?:=(?:{QO}|{e}))?"
    var = rf"{mods}{ty}a(?:{K0})*{init}(?:,a(?:{K0})*{init})*+"
    clsh = rf"{mods}@?Ca(?:{PD})?(?:X{ty}(?:,{ty})*|a{ty}(?:,{ty})*)*"
    cls = rf"{clsh}(?:{QC}|{QE})"
    stmt = (
        rf"(?:;|{QB}|I{PE}|H(?:{PE}|{PH})|E|D|a:(?!:)|T(?:{PH}|{PE}|{PG})?{QB}(?:c{PD}{QB})*(?:f{QB})?|S{PE}{QS}|{var};|y{PE}{QB}|R{e}(?::{e})?;|R;|Ba?;|a{e};|{cls}|{es};)"
    )
    body = rf"(?:(?:m)?{QB}|;|{mods}{ty}a{PD}(?:{K0})*(?:h{ty}(?:,{ty})*)?(?:d(?:{e}|{QO}))?(?:{QB}|;)|{mods}a(?:{PD})?(?:h{ty}(?:,{ty})*)?{QB}|{var};|{cls})"
    case = rf"(?:k(?:{e1}|{ty}a)(?:,{e1})*(?::|w)|d(?::|w)|{stmt})*+"
    const = rf"(?:{ann})*a{PE}?{QC}?"
    pm = rf"{mods}{ty}e?(?:a|(?:a\.)?t)(?:{K0})*"
    paren = {
        1: rf"(?:{es})?|(?:a=(?:{e}|{QO})(?:,a=(?:{e}|{QO}))*)|{QO}", 2: rf"(?:{pm}(?:,{pm})*+)?|m?{ty}(?:\|{ty})*a|a(?:,a)*",
        4: rf"(?:{var}|{es})?;(?:{e})?;(?:{es})?|{mods}{ty}a:{e}|{var}(?:;{var})*;?", 8: rf"{ty}(?:&{ty})*",
    }
    bracket = {1: e, 2: ""}
    brace = {1: rf"(?:{stmt})*+", 2: rf"(?:(?:{e}|{QO}|{ann})(?:,(?:{e}|{QO}|{ann}))*+)?,?", 4: rf"(?:{body})*+", 8: case, 16: rf"(?:{const}(?:,{const})*+)?,?(?:;(?:{body})*+)?"}
    generic = re.compile(rf"(?<=[a.mvdN,{Q_SET};])<(?:[a.,?vX&@]|(?<=\?)t|{K0})*>|^<[aX,.&]*>")

    def prepare(s: str, kind: str) -> str:
        if "<" in s:
            while True:
                t = generic.sub("", s)
                if t == s:
                    break
                s = t
            s = re.sub(r"(?<=\?)t", "", s)
        return s

    top = rf"(?:(?:{ann})*Pa(?:\.a)*;)?(?:im?a(?:\.a)*(?:\.\*)?;|;)*+(?:{cls}|;)*+"
    return Grammar("java", paren, bracket, brace, top, prepare)


# ---------------------------------------------------------------- Go
def _go() -> Grammar:
    base = rf"(?:a(?:\.a)?(?:{KE})?|C{QI}|{PT}|F{PD}(?:{PD}|(?:[*h]|{ANYK})*(?:a(?:\.a)?|C{QI}))?)"
    pre = rf"(?:\*|{ANYK}|m{KE}|hV?|Vh)"
    ty = rf"(?:{pre}*+{base})"
    res = rf"(?:{PD}|{ty})"

    def exprs(composite: bool):
        lit = rf"|(?:(?:{ANYK}|m{KE})(?:{pre})*{base}|C{QI}){QO}"
        post = rf"(?:\.a|\.{ANYP}|\.T|{PE}|{PT}|{KE}" + (rf"|(?<=[a{K_SET}]){QO}" if composite else "") + ")"
        opnd = rf"(?:F{PD}{res}?{QB}{lit}|(?:{ANYK}|m{KE}|h|\*)(?:{pre})*{base}(?={ANYP}|,|\Z)|C{QI}|[a0s]|{PE}|{PT})"
        unit = rf"[!p*&V~]*+{opnd}{post}*+"
        e = rf"(?:{unit}(?:(?:[bp<>*&]|V){unit})*+)"
        return e

    e, eh = exprs(True), exprs(False)

    def simple(x: str) -> str:
        return rf"(?:{x}(?:,{x})*+(?:=(?:{x}(?:,{x})*+)|q)?)"

    head = rf"(?:(?:{simple(eh)})?;)?"
    rng = rf"(?:{eh}(?:,{eh})*=)?r{eh}"
    iff = rf"I{head}{simple(eh)}{QB}"
    name = r"a(?:,a)*"
    value = rf"{name}(?:{ty})?(?:=(?:{e})(?:,{e})*+)?"
    typ = rf"a(?:{ANYK})?=?{ty}"
    one = (
        rf"(?:{QB}|{iff}(?:E{iff})*(?:E{QB})?|H(?:{rng}|{head}(?:{simple(eh)})?(?:;(?:{simple(eh)})?)?)?{QB}|S{head}(?:{simple(eh)})?{QS}|L(?:{value}|{PG})|T(?:{typ}|{PG})"
        rf"|R(?:{e}(?:,{e})*+)?|Ba?|g{e}|{simple(e)})"
    )
    label = r"(?:a:;?)*"
    stmts = rf"(?:{label}(?:{one})?;)*+(?:{label}{one})?;?"
    case = rf"(?:(?:k(?:{simple(e)}|{ty}(?:,{ty})*)|d):;?(?:{label}(?:{one})?;)*+(?:{label}{one})?;?)*+"
    item = rf";*(?:(?:{e}|{QO}):)?(?:{e}|{QO})"
    par = rf"(?:(?:a)?e?{ty})"
    imp = r"(?:[a.]?s)"
    fld = rf"(?:a(?:,a)*{ty}s?|\*?a(?:\.a)?(?:{KE})?s?|a{PD}{res}?|~?{ty}(?:b~?{ty})*)"
    paren = {1: rf"(?:(?:{e}|{ty})(?:,(?:{e}|{ty}))*+e?,?)?", 2: rf"(?:{par}(?:,{par})*+,?)?", 8: rf"{ty}|T", 16: rf"(?:(?:{imp}|{value}|{typ})?;)*+(?:{imp}|{value}|{typ})?"}
    bracket = {1: rf"{e}|{e}?:{e}?(?::{e})?|{ty}(?:,{ty})*|a(?:,a)*~?{ty}(?:b~?{ty})*(?:,a(?:,a)*~?{ty}(?:b~?{ty})*)*,?", 2: "|0|e"}
    brace = {1: stmts, 2: rf"(?:{item}(?:,{item})*+,?)?;*", 8: case, 32: rf"(?:(?:{fld})?;)*+(?:{fld})?"}
    semi = re.compile(rf"(?<=[a0sRBq{P_SET}{K_SET}{Q_SET}])n+")

    def prepare(s: str, kind: str) -> str:
        return semi.sub(";", s).replace("n", "")

    top = rf"Pa;(?:i(?:{imp}|{PG});)*+(?:(?:F(?:{PD})?a(?:{ANYK})?{PD}{res}?(?:{QB})?|L(?:{value}|{PG})|T(?:{typ}|{PG}))?;)*+"
    return Grammar("go", paren, bracket, brace, top, lambda s, k: prepare(s, k) if k else prepare(s + "n", k))


# ---------------------------------------------------------------- C
def _c() -> Grammar:
    spec = rf"(?:m|v|C(?:a{QE}|a{QI}|a|{QI}|{QE})|a(?={ANYP}[amvC*])(?:{ANYP})|a)"
    specs = rf"(?:{spec})+"
    post = rf"(?:\.a|{PE}|{PT}|{KE}|q)"
    opnd = rf"(?:{PT}{QO}|z(?:{PT}|{PE})|a?s(?:a?s|a(?=s|\Z|,))*|[a0]|{PE}|{PE}?{QB}(?!.))"
    una = rf"(?:[!~pq*&]|z|{PT}(?=[a0s!~pq*&z{P_SET}]))"
    unit = rf"(?:{una})*+{opnd}{post}*+"
    e1 = rf"(?:{unit}(?:[b=p<>*&]{unit})*+)"
    e = rf"(?:{e1}(?:\?{e1}(?:\?{e1})*+:{e1}(?:[?:]{e1})*+)?+)"
    es = rf"{e}(?:,{e})*+"
    dcl = rf"[*m]*(?:a|{ANYP})(?:{ANYK}|{PD}|{PE})*(?:a{ANYP})*"
    init = rf"(?::{e})?(?:=(?:{QO}|{e}))?"
    decl = rf"(?:{specs}(?:{dcl}{init}(?:,{dcl}{init})*+)?|A{PE});"
    stmt = rf"(?:;|{QB}|I{PE}|H(?:{PE}|{PH})|E|D|a:(?!:)|k{e1}(?:e{e1})?:|d:|R{es};|R;|B;|ga;|{es};|{decl})"
    fn = rf"(?:{spec}|\*)*?a{ANYP}(?:a{ANYP}|a)*(?:{specs}{dcl};)*{QB}"
    pm = rf"(?:{specs}(?:[*m]*(?:a|{ANYP})?(?:{ANYK}|{ANYP})*))"
    tyn = rf"{specs}[*m]*(?:{ANYP}|{ANYK})*"
    item = rf"(?:(?:(?:\.a|{ANYK})+=)?(?:{e}|{QO}))"
    con = rf"a(?:={e})?"
    paren = {1: rf"(?:(?:{e}|{tyn}|{QB})(?:,(?:{e}|{tyn}|{QB}))*+)?", 2: rf"(?:{pm}(?:,{pm})*+(?:,e)?)?|e|{dcl}", 4: rf"(?:{es};|{decl}|;)(?:{es})?;(?:{es})?", 8: tyn}
    bracket = {1: rf"(?:{e}|m*{e}|)|\*"}
    brace = {1: rf"(?:{stmt})*+", 2: rf"(?:{item}(?:,{item})*+)?,?", 16: rf"{con}(?:,{con})*+,?", 32: rf"(?:{decl}|;)*+"}
    top = rf"(?:;|a{ANYP}(?={spec}|\Z)|{decl}|{fn})*+"
    return Grammar("c", paren, bracket, brace, top, lambda s, k: s.replace("#", ""))


class Grammars(dict):
    """Grammars by language, each compiled where it is first asked for."""

    made = {"js": lambda: _script(False), "ts": lambda: _script(True), "java": _java, "go": _go, "c": _c}

    def __missing__(self, lang: str):
        self[lang] = g = self.made[lang]()
        return g


GRAMMARS = Grammars()

_INNER = re.compile(r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")
_HAS = re.compile(r"[()\[\]{}]")


def reduced(s: str, lang: str) -> str:
    """The shape with every balanced group closed, innermost first; the reduction of joined chunks is that of their reductions."""
    close = GRAMMARS[lang].close
    step = lambda m: close(m[0])
    n = 1
    while n and BAD not in s:
        s, n = _INNER.subn(step, s)
    return BAD if BAD in s else s


def owed(s: str) -> str:
    """The bracket summary of a reduced chunk: closers it owes to the left, openers it leaves to the right."""
    return "".join(_HAS.findall(s))


def accepted(s: str, lang: str) -> bool:
    """Whether a reduced shape of a whole file is a file of the language."""
    if BAD in s or _HAS.search(s):
        return False
    return GRAMMARS[lang].whole(s)
