"""TeX sources as plain words: what a reader would see, without markup.

The words come in two readings: the *text* reading leaves comments out, as TeX does,
and the *source* reading keeps them and only drops the comment signs, so that a passage
in a commented draft is found as well as one that foreign comment lines interrupt.
"""

from __future__ import annotations

import re
import unicodedata

# TeX names of letters.
LETTERS = {"ss": "ss", "ae": "ae", "AE": "ae", "oe": "oe", "OE": "oe", "o": "o", "O": "o", "l": "l", "L": "l", "aa": "a", "AA": "a", "i": "i", "j": "j", "dh": "d", "DH": "d", "th": "th", "TH": "th", "dj": "d", "DJ": "d", "ng": "ng", "NG": "ng"}
# Commands whose argument is no text.
SILENT = ("cite", "citep", "citet", "citealt", "citealp", "citeauthor", "citeyear", "parencite", "textcite", "autocite", "footcite", "nocite", "label", "index", "glossary", "ref", "eqref", "pageref", "autoref", "cref", "Cref", "nameref", "vref", "vspace", "hspace", "todo", "marginpar", "hypertarget", "phantomsection", "input", "include", "subfile", "bibliography", "bibliographystyle", "includegraphics", "usepackage", "documentclass", "documentstyle")

_DEFINE = re.compile(r"\\(?:(?:re)?newcommand|providecommand|DeclareRobustCommand)\*?\s*\{?\s*\\([A-Za-z@]+)\s*\}?\s*(?:\[(\d)\])?\s*(?:\[([^\]]*)\])?\s*(?=\{)|\\(?:[gex]?def)\s*\\([A-Za-z@]+)\s*((?:#\d)*)\s*(?=\{)|\\let\s*\\([A-Za-z@]+)\s*=?\s*(\\[A-Za-z@]+)")
_SILENT = re.compile(r"\\(?:" + "|".join(sorted(SILENT, key=len, reverse=True)) + r")\*?(?![A-Za-z])\s*(?:\[[^\]]*\]\s*)*\{[^{}]*\}")
_ENVIRONMENT = re.compile(r"\\(?:begin|end)\s*\{[^{}]*\}(?:\[[^\]\n]*\])?")
_ACCENT = re.compile(r"\\(?:[\"'`^~=.]\s*|[uvHcdbtrk](?![A-Za-z])\s*)(?:\{\s*\\?([A-Za-z]{1,2})\s*\}|\\([ij])(?![A-Za-z])\s?|([A-Za-z]))")
_LETTER = re.compile(r"\{\\(" + "|".join(LETTERS) + r")\s*\}|\\(" + "|".join(LETTERS) + r")(?![A-Za-z])(?:\{\}|[ \t]+)?")
_GLUE = re.compile(r"\\[-/!]")
_INVISIBLE = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")
_DOUBLE_ENCODED = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u2022\u2026\u2030\u2039\u203a\u20ac\u2122]+")
_COMMAND = re.compile(r"\\[A-Za-z@]+\*?")
_LINE_HYPHEN = re.compile(r"-[ \t]*\r?\n[ \t]*(?=\w)")
_ANY_LINE_HYPHEN = re.compile("[-\u2010\u2011][ \t]*\r?\n[ \t]*(?=\\w)")
_COMMENT_LINE = re.compile(r"^[ \t]*%.*(?:\r?\n|\r|\Z)", re.M)
_COMMENT_TAIL = re.compile(r"(?<!\\)%.*(?:\r?\n[ \t]*|\r[ \t]*|\Z)")
_COMMENT_SIGN = re.compile(r"^[ \t]*%+[ \t]?", re.M)
_WORD = re.compile(r"[^\W_]+")
_ASCII_GAPS = {i: " " for i in range(128) if not chr(i).isalnum()}
_ASCII_GAPS |= dict.fromkeys(map(ord, "'`\"{}")) | {c: chr(c + 32) for c in range(65, 91)}


def _group(text: str, at: int) -> tuple[str, int] | None:
    """The content of the brace group that opens at ``at``, and where it ends."""
    depth = 0
    for i in range(at, len(text)):
        c = text[i]
        if c == "{" and text[i - 1 : i] != "\\":
            depth += 1
        elif c == "}" and text[i - 1 : i] != "\\":
            depth -= 1
            if not depth:
                return text[at + 1 : i], i + 1
    return None


#: Growth at which macros count as running away: what they stand for may make a text this
#: many times as long as it was, and at least LEAST_GROWTH characters longer.
GROWTH = 16
LEAST_GROWTH = 1_000_000
_OPTION = re.compile(r"\s*\[([^\]]*)\]")
_ARGUMENT = re.compile(r"\s*(?=\{)")
_HELD = "\ue0ff"  # between the backslash and the name of a call that is not expanded


def _definitions(text: str) -> tuple[str, dict[str, tuple[int, str | None, str]]]:
    """The text without its definitions, and name -> (arguments, default of the first one,
    body).  The last definition of a name holds."""
    macros: dict[str, tuple[int, str | None, str]] = {}
    out, at = [], 0
    for m in _DEFINE.finditer(text):
        if m.start() < at:
            continue
        if m[6]:
            macros[m[6]] = (0, None, m[7])
            out.append(text[at : m.start()])
            at = m.end()
            continue
        body = _group(text, m.end())
        if body is None:
            continue
        n = int(m[2] or 0) if m[1] else m[5].count("#")
        macros[m[1] or m[4]] = (n, m[3] if m[1] else None, body[0])
        out.append(text[at : m.start()])
        at = body[1]
    return "".join(out) + text[at:], macros


def _replace_calls(text: str, call: re.Pattern, macros: dict[str, tuple[int, str | None, str]], most: int) -> str | None:
    """The text with its outermost calls replaced by the macros' bodies; null where it would
    be longer than ``most``, the text itself where it has no call."""
    out, at, size = [], 0, 0
    for m in call.finditer(text):
        if m.start() < at:
            continue
        n, default, body = macros[m[1]]
        out.append(text[at : m.start()])
        at = m.end()
        if n:
            args = []
            if default is not None:
                o = _OPTION.match(text, at)
                args.append(o[1] if o else default)
                at = o.end() if o else at
            while len(args) < n:
                o = _ARGUMENT.match(text, at)
                g = _group(text, o.end()) if o else None
                if g is None:
                    break
                args.append(g[0])
                at = g[1]
            body = re.sub(r"#(\d)", lambda x: args[int(x[1]) - 1] if 0 < int(x[1]) <= len(args) else "", body)  # noqa: B023
        out.append(body)
        size += len(out[-1]) + len(out[-2])
        if size > most:
            return None
    return "".join(out) + text[at:] if out else text


def expand_macros(text: str) -> str:
    """The text with the document's own macros replaced by what they stand for, and
    without their definitions, however long the text and however deep the macros.

    The last definition of a name holds, as it does where the text follows the preamble.
    A macro that leads back to itself is replaced once; the call that closes the circle
    stays as it is.  A macro that runs away (see GROWTH) is left as it is."""
    text, macros = _definitions(text)
    if not macros:
        return text
    most = GROWTH * len(text) + LEAST_GROWTH
    call = re.compile(r"\\(" + "|".join(sorted(map(re.escape, macros), key=len, reverse=True)) + r")(?![A-Za-z@])(?:\{\})?")
    needs = {name: list(dict.fromkeys(m[1] for m in call.finditer(body))) for name, (_, _, body) in macros.items()}
    full: dict[str, tuple[int, str | None, str]] = {}
    for first in macros:  # bodies are expanded in the order of what they need
        trail, open_ = [(first, iter(needs[first]))], {first}
        while trail and first not in full:
            name, rest = trail[-1]
            nxt = next((x for x in rest if x not in full and x not in open_), None)
            if nxt is not None:
                trail.append((nxt, iter(needs[nxt])))
                open_.add(nxt)
                continue
            trail.pop()
            open_.discard(name)
            n, default, body = macros[name]
            body = call.sub(lambda m: m[0] if m[1] in full else "\\" + _HELD + m[0][1:], body)
            full[name] = (n, default, _rewritten(body, call, full, most))
    return _rewritten(text, call, full, most).replace("\\" + _HELD, "\\")


def _rewritten(text: str, call: re.Pattern, macros: dict[str, tuple[int, str | None, str]], most: int) -> str:
    """All calls replaced; each round takes those that are in no other's argument."""
    while True:
        nxt = _replace_calls(text, call, macros, most)
        if nxt is None:
            return call.sub(lambda m: "\\" + _HELD + m[0][1:], text)
        if nxt == text:
            return text
        text = nxt


def _recode(m: re.Match) -> str:
    """UTF-8 that was read as a Western code page, put right; else as it is."""
    for page in ("cp1252", "latin-1"):
        try:
            return m[0].encode(page).decode("utf-8")
        except UnicodeError:
            pass
    return m[0]


def plain_words(text: str) -> list[str]:
    """The words of a TeX text: lower case, without markup, marks and punctuation."""
    if "\\" in text:
        text = _ENVIRONMENT.sub(" ", _SILENT.sub("", text))
        text = _ACCENT.sub(lambda m: m[1] or m[2] or m[3], text)
        text = _LETTER.sub(lambda m: LETTERS[m[1] or m[2]], text)
        text = _COMMAND.sub("", _GLUE.sub("", text.replace("\\\\", " ")))
    if text.isascii():
        return _LINE_HYPHEN.sub("", text).translate(_ASCII_GAPS).split()
    text = _INVISIBLE.sub("", _DOUBLE_ENCODED.sub(_recode, text))
    text = unicodedata.normalize("NFKD", _ANY_LINE_HYPHEN.sub("", text)).casefold()
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = re.sub("[\u2018\u2019\u02bc\u2032\u201c\u201d\u201e\u00ab\u00bb]", "", text).translate(_ASCII_GAPS)
    return text.split() if text.isascii() else _WORD.findall(text)


def readings(text: str | None) -> list[list[str]]:
    """The words of a source: the text reading, and the source reading where comments
    make a difference.  Null and blank texts have none."""
    if not text or text.isspace():
        return []
    if "\\def" in text or "command" in text or "\\let" in text or "Command" in text:
        text = expand_macros(text)
    if "%" not in text:
        return [plain_words(text)]
    shown = _COMMENT_TAIL.sub("", _COMMENT_LINE.sub("", text))
    return [plain_words(shown), plain_words(_COMMENT_SIGN.sub("", text))]
