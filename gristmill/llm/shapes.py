"""Token shapes of source text, and their associative reduction.

A source text becomes a *shape*: one character per token, so that a name is ``a``,
a number ``0``, a string ``s``, and so on.  Shapes of neighbouring chunks can be
joined and reduced in any grouping: a reduction replaces an innermost, balanced
bracket group by one character that says in which roles (block, object, class body,
argument list ...) its content is right by the local grammar.  What is left of a
chunk is its bracket summary: the closers it still owes to chunks before it, the
openers it leaves to chunks after it, and the reduced statements between them.

The table of a language maps each lexer state in which a chunk may begin to the
shape it then has and the state in which it ends, which is what lets chunks of one
large file be lexed apart.
"""

from __future__ import annotations

import re

BAD = "\x00"

# Keywords as fixed values, grouped by the class that the local grammars use.
WORDS = {
    "js": {
        "F": "function", "A": "async", "r": "public private protected interface implements package", "C": "class", "X": "extends", "L": "const let var", "I": "if", "H": "for while with", "E": "else", "D": "do",
        "T": "try", "c": "catch", "f": "finally", "S": "switch", "k": "case", "d": "default", "R": "return throw", "B": "break continue", "y": "typeof void delete await",
        "Y": "yield", "N": "new", "b": "instanceof in", "i": "import", "x": "export", "t": "this super null true false",
        "g": "debugger", BAD: "enum",
    },
    "java": {
        "C": "class interface enum", "X": "extends implements", "h": "throws", "I": "if", "H": "for while", "E": "else", "D": "do", "T": "try", "c": "catch",
        "f": "finally", "S": "switch", "k": "case", "d": "default", "R": "return throw assert", "B": "break continue", "N": "new", "o": "instanceof", "i": "import", "P": "package",
        "t": "this super null true false", "y": "synchronized", "m": "public private protected static final abstract native transient volatile strictfp",
        "v": "void int long double float boolean char byte short", BAD: "goto const",
    },
    "go": {
        "F": "func", "I": "if", "H": "for", "E": "else", "S": "switch select", "k": "case", "d": "default", "R": "return", "B": "break continue goto fallthrough", "g": "go defer", "i": "import",
        "P": "package", "T": "type", "L": "var const", "C": "struct interface", "m": "map", "h": "chan", "r": "range",
    },
    "c": {
        "C": "struct union enum", "I": "if", "H": "for while switch", "E": "else", "D": "do", "k": "case", "d": "default", "R": "return", "B": "break continue", "g": "goto", "z": "sizeof _Alignof",
        "v": "void int long double float char short signed unsigned _Bool _Complex", "m": "static const extern inline register volatile auto restrict typedef _Noreturn _Thread_local", "A": "_Static_assert",
    },
}
WORDS["ts"] = {k: v for k, v in WORDS["js"].items() if k not in (BAD, "r")} | {"J": "enum"}

OPS = {
    "...": "e", "=>": "w", "++": "q", "--": "q", "+": "p", "-": "p", "?.": ".", "?": "?", ":": ":", ".": ".", ",": ",", ";": ";", "!": "!", "~": "!", "@": "@",
    "<": "<", ">": ">", "*": "*", "&": "&", "=": "=", "{": "{", "}": "}", "(": "(", ")": ")", "[": "[", "]": "]",
} | dict.fromkeys(["+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "**=", "&&=", "||=", "??="], "=") | dict.fromkeys(["==", "===", "!=", "!==", "<=", ">=", "&&", "||", "|", "^", "/", "%", "<<", ">>", ">>>", "**", "??"], "b")
ONLY = {
    "js": {"#": BAD},
    "ts": {"|": "|", ">>": ">>", ">>>": ">>>"},
    "java": {"->": "w", "::": ".", "|": "|", ">>": ">>", ">>>": ">>>"} | dict.fromkeys(["?.", "=>", "===", "!==", "**", "??", "#"], BAD),
    "go": {"<-": "V", ":=": "=", "&^": "b", "&^=": "=", "~": "!", "^": "p"} | dict.fromkeys(["?.", "=>", "===", "!==", "**", "??", "#", "@", "?", ">>>"], BAD),
    "c": {"->": "."} | dict.fromkeys(["?.", "=>", "===", "!==", "**", "??", "#", "@", ">>>"], BAD),
}

_NUM = r"\.?\d(?:[eEpP][+-]|[\w.'])*"
_OP = r">>>=|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|>>>|\.\.\.|&\^=|=>|->|<-|:=|::|&\^|\+\+|--|\?\.(?!\d)|\?\?|[-+*/%&|^<>=!]=|&&|\|\||<<|>>|\*\*|[-+*/%&|^<>=!~?:;,.@(){}\[\]]"
_MARK = r"(?m:^)(?:<{7}|={7}|>{7}|\|{7})(?=[ \r\n]|\Z)"
_NAME = r"[^\W\d][\w$]*|\$[\w$]*"
_LINE, _BLOCK = r"//[^\n]*", r"/\*(?:[^*]|\*(?!/))*+\*/"
_DQ, _SQ = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*+"', r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*+'"
_NL = r"\n\s*"
_TICK = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+`"
_REGEX = r"(?:[=(,:\[!&|?;+{}]|\breturn|\btypeof|\bcase|=>)\s*/(?![*/])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*"
_TOKENS = {
    "js": "|".join((_MARK, _REGEX, _NAME, _NL, _LINE, _BLOCK, _DQ, _SQ, _TICK, _NUM, _OP, r"#!?[^\W\d][\w$]*", r"\S")),
    "java": "|".join((_MARK, _NAME, r'"""[ \t\r\f]*\n(?:[^"\\]|\\[\s\S]|"(?!""))*+"""', _LINE, _BLOCK, _DQ, r"'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|[^\n]))'", _NUM, _OP, r"\S")),
    "go": "|".join((_MARK, _NAME, _NL, _LINE, _BLOCK, r'"(?:[^"\\\n]|\\[^\n])*+"', r"'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|[^\n]))'", r"`[^`]*+`", _NUM, _OP, r"\S")),
    "c": "|".join((_MARK, r"(?m:^)[ \t]*#(?:[^\n\\/]|\\\r?\n|\\|/(?!\*)|/\*(?:[^*]|\*(?!/))*+\*/)*+", r"(?:u8|[uUL])?(?=\"|')(?:" + _DQ + "|" + _SQ + ")", _NAME, _LINE, _BLOCK, _NUM, _OP, r"\S")),
}
_TOKENS["ts"] = _TOKENS["js"]
TOKENS = {k: re.compile(v) for k, v in _TOKENS.items()}


class Classes(dict):
    """Class of each token text; texts that are not names, words or operators are told by their first character and not kept."""

    def __init__(self, lang: str):
        super().__init__({w: k for k, ws in WORDS[lang].items() for w in ws.split()} | OPS | ONLY[lang])
        self.lang = lang

    def __missing__(self, t: str) -> str:
        c = t[0]
        if c == "/":
            if len(t) > 1 and t[1] in "/*":
                return "n" if t[1] == "*" and "\n" in t and self.lang in ("js", "ts", "go") else ""
            return BAD
        if c == "\n":
            return "n"
        if c in "\"'`":
            if len(t) == 1:
                return BAD
            return "s"
        if c.isalpha() or c in "_$":
            if t[-1] in "\"'":  # prefixed C literal
                return "s"
            if t[-1] == "/" or (t.startswith(("return", "typeof", "case")) and "/" in t):
                return self[re.match(r"\w+", t)[0]] + "s"
            if len(self) < 200_000:
                self[t] = "a"
            return "a"
        if c.isdigit() or (c == "." and len(t) > 1):
            return number(t, self.lang)
        if len(t) > 1 and "/" in t and self.lang in ("js", "ts"):  # a regular expression behind a sign
            sign = "=>" if t.startswith("=>") else c
            return self[sign] + ("n" if "\n" in t.partition("/")[0] else "") + "s"
        if c == "#" and len(t) > 1 and self.lang in ("js", "ts"):
            return "a" if t[1] != "!" else BAD
        if self.lang == "c" and t.lstrip()[:1] == "#":
            return "#"
        return BAD


_NUMBERS = re.compile(r"0[xX][\da-fA-F_']+(?:\.[\da-fA-F]*)?(?:[pP][+-]?\d+)?[uUlLnfF]{0,3}|0[bB][01_']+[uUlLn]{0,3}|0[oO][0-7_]+n?|(?:[\d_']+\.?[\d_']*|\.[\d_']+)(?:[eE][+-]?[\d_]+)?(?:[uUlLfFdDni]{0,3})")


def number(t: str, lang: str) -> str:
    if t.isdigit() or _NUMBERS.fullmatch(t):
        return "0"
    m = re.fullmatch(r"(\d+)(\.\.?)([^\W\d]\w*)", t)  # 1.e5 is read above; 1..name is a member of a number
    return "0.a" if m and lang in ("js", "ts") and m[2] == ".." else BAD


CLASSES = {k: Classes(k) for k in TOKENS}

_IF = re.compile(r"[ \t]*#[ \t]*(if|ifdef|ifndef|elif|else|endif)\b[ \t]*([^\n]*)")


def preprocessed(text: str) -> str:
    """C text with the lines of branches not taken made empty: ``#if 0`` and every branch after a taken one."""
    if "#" not in text or not re.search(r"(?m)^[ \t]*#[ \t]*(?:else|elif|if[ \t]+0|ifdef[ \t]+__cplusplus)", text):
        return text
    out, stack = [], []
    for line in text.split("\n"):
        m = _IF.match(line)
        if m:
            w = m[1]
            if w.startswith("if"):
                stack.append(not (re.match(r"0\s*(?:$|/)", m[2].strip()) if w == "if" else w == "ifdef" and m[2].startswith("__cplusplus")))
                stack.append(stack[-1])  # whether a branch was taken yet
            elif w == "endif" and len(stack) >= 2:
                del stack[-2:]
            elif len(stack) >= 2 and w in ("elif", "else"):
                stack[-2] = not stack[-1]
                stack[-1] = True
        out.append(line if m or all(stack[::2]) else " " * len(line))  # offsets stay
    return "\n".join(out)


_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+")


def flat_templates(text: str) -> str:
    """JavaScript text in which template literals with holes are replaced by calls of the holes: `a${x}b` becomes `` ``+(x)+`` ``."""
    out, i, n = [], 0, len(text)
    scan = re.compile(_TOKENS["js"])
    depth: list[int] = []
    level = 0
    while i < n:
        if depth and level == depth[-1] and text[i] == "}":  # back in the template
            depth.pop()
            i += 1
            lead = ")"
        elif text[i] == "`":
            i += 1
            lead = ""
        else:
            m = scan.match(text, i)
            if not m:
                out.append(text[i])
                i += 1
                continue
            t = m[0]
            if t[0] == "`" and len(t) == 1:
                i += 1
                lead = ""
            else:
                if t == "{":
                    level += 1
                elif t == "}":
                    level -= 1
                elif t[0] in "{}" and len(t) > 1:
                    level += 1 if t[0] == "{" else -1
                out.append(t)
                i = m.end()
                continue
        m = _TEXT.match(text, i)
        tick = "`" + "\n" * m[0].count("\n") + "`"  # line numbers stay
        i = m.end()
        if i >= n:
            return "".join(out) + lead + BAD
        if text[i] == "`":
            out.append(lead + ("+" if lead else "") + tick)
            i += 1
        else:
            out.append(lead + ("+" if lead else "") + tick + "+(")
            depth.append(level)
            i += 2
    return "".join(out) + (BAD if depth else "")


_RECORD = re.compile(r"\brecord(?=\s+[A-Za-z_]\w*\s*(?:<[^{}()]*>)?\s*\([^{}]*\)\s*(?:implements\b|\{))")


def records(text: str) -> str:
    """Java text in which ``record`` is a class where it is no name; offsets stay."""
    return _RECORD.sub("class ", text) if "record" in text else text


def shape(text: str, lang: str) -> str:
    """The shape of a whole text, or of a chunk that begins in the state ``code``."""
    if text[:1] == "﻿":
        text = text[1:]
    if lang == "c":
        text = preprocessed(text)
    elif lang == "java":
        text = records(text)
    elif lang in ("js", "ts"):
        if "${" in text:
            text = flat_templates(text)
        if text.startswith("#!"):
            text = "//" + text[2:]
    return "".join(map(CLASSES[lang].__getitem__, TOKENS[lang].findall(text)))
