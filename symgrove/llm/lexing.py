"""Comments, strings and running text of source code, by language family."""

from __future__ import annotations

import re

import regex

#: File suffixes of each family.
C_LIKE = {"c", "h", "cc", "cpp", "cxx", "hpp", "hxx", "inl"}
SUFFIXES = {**dict.fromkeys(C_LIKE, "cpp"), "java": "java", "go": "go", "py": "python", "pyi": "python", "ts": "script", "tsx": "script", "js": "script", "jsx": "script", "mjs": "script", "cjs": "script"}
NAMES = {"cpp": "cpp", "c++": "cpp", "c": "cpp", "cxx": "cpp", "java": "java", "go": "go", "golang": "go", "python": "python", "py": "python", "python3": "python", "typescript": "script", "ts": "script", "javascript": "script", "js": "script", "tsx": "script"}

#: Where a slash begins a pattern rather than a division.
REGEX_PLACE = r"(?<=[(,=:\[!&|?{};+*%<>~^\n][ \t]*|\b(?:return|case|typeof|in|of)[ \t]+|\A[ \t]*)"
#: Lexical rules of each family, as parts of a ``regex`` pattern: comment, string, and what is neither but may hold quotes.
RULES: dict[str, dict[str, str]] = {
    "cpp": {
        "com": r"//(?:\\\n|[^\n])*+ | /\*(?s:.*?)(?:\*/|\Z)",
        "str": r"(?:u8|[uUL])?R\"(?P<delim>[^\s()\\\"]{0,16})\((?s:.*?)\)(?P=delim)\" | \"(?:\\(?s:.)|[^\"\\\n])*+\" | '(?:\\(?s:.)|[^'\\\n])++'",
        "skip": r"(?<!\w)\d(?:'(?=\w)|[\w.])*+",
    },
    "java": {
        "com": r"//[^\n]*+ | /\*(?s:.*?)(?:\*/|\Z)",
        "str": r"\"\"\"[ \t]*\n(?:\\(?s:.)|(?!\"\"\")(?s:.))*+\"\"\" | \"(?:\\(?s:.)|[^\"\\\n])*+\" | '(?:\\(?s:.)|[^'\\\n])++'",
    },
    "go": {
        "com": r"//[^\n]*+ | /\*(?s:.*?)(?:\*/|\Z)",
        "str": r"`[^`]*+` | \"(?:\\(?s:.)|[^\"\\\n])*+\" | '(?:\\(?s:.)|[^'\\\n])++'",
    },
    "python": {
        "com": r"\#[^\n]*+",
        "str": r"(?<!\w)[rRbBuUfFtT]{0,2}(?: \"\"\"(?:\\(?s:.)|(?!\"\"\")(?s:.))*+\"\"\" | \'\'\'(?:\\(?s:.)|(?!\'\'\')(?s:.))*+\'\'\' | \"(?:\\(?s:.)|[^\"\\\n])*+\" | '(?:\\(?s:.)|[^'\\\n])*+' )",
    },
    "script": {
        "com": r"//[^\n]*+ | /\*(?s:.*?)(?:\*/|\Z)",
        "str": r"(?P<tpl> `(?: \\(?s:.) | \$(?P<hole> \{(?: [^{}`\"']++ | (?&tpl) | \"(?:\\(?s:.)|[^\"\\\n])*+\" | '(?:\\(?s:.)|[^'\\\n])*+' | (?&hole) )*+\} ) | \$(?!\{) | [^`\\$] )*+` ) | \"(?:\\(?s:.)|[^\"\\\n])*+\" | '(?:\\(?s:.)|[^'\\\n])*+'",
        "skip": REGEX_PLACE + r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\[\n])++/[a-z]*+",
    },
}
_LEXERS = {fam: regex.compile(rf"(?P<c> {r['com']} ) | (?P<s> {r['str']} )" + (rf" | (?: {r['skip']} )" if "skip" in r else ""), regex.X) for fam, r in RULES.items()}
_LINE = re.compile(r"^[ \t]*(?:///?!?<?|//!<?|/\*+[*!]?<?|\*+/|\*(?!\*)|\#+!?)?[ \t]?")
_END = re.compile(r"[ \t]*\*+/[ \t]*$")


def family(language: str | None, path: str | None) -> str:
    """Family of a file: its suffix decides, else the stated language in any spelling, else C-like."""
    suffix = (path or "").rsplit(".", 1)[-1].lower() if "." in (path or "") else ""
    return SUFFIXES.get(suffix) or NAMES.get((language or "").strip().lower()) or "cpp"


def clean_comment(text: str) -> str:
    """Text of a comment without its markers, line by line."""
    return "\n".join(_END.sub("", _LINE.sub("", x, count=1)).strip() for x in text.split("\n")).strip()


def string_text(literal: str, fam: str) -> str:
    """Content of a string literal; escapes are resolved where the kind of literal has them."""
    head = regex.match(r"\w*", literal)[0].lower()
    body = literal[len(head) :]
    if fam == "cpp" and head.endswith("r"):
        return body[body.index("(") + 1 : body.rindex(")")]
    quote = body[:3] if body[:3] in ('"""', "'''") and len(body) >= 6 else body[:1]
    body = body[len(quote) : -len(quote)]
    if fam == "go" and quote == "`" or fam == "python" and "r" in head:
        return body
    return unescape(body)


def unescape(s: str) -> str:
    """Resolve the escapes of a string literal, those of characters by number too."""
    if "\\" not in s:
        return s

    def one(m):
        if m[1]:
            return chr(min(int(m[1][1:], 16), 0x10FFFF))
        return {"n": "\n", "t": "\t", "r": "\n"}.get(m[2], m[2])

    s = re.sub(r"\\(?:(u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2})|(.))", one, s, flags=re.S)
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if re.search(r"[\ud800-\udfff]", s) else s


def pieces(code: str, fam: str) -> list[tuple[str, int, int, str]]:
    """(``comment`` or ``string``, start, end, text) of all comments and strings.

    Comment lines that follow each other on lines of their own are one piece, and
    so are string literals with nothing but white space or a plus sign between them.
    """
    out: list[tuple[str, int, int, str]] = []
    for m in _LEXERS[fam].finditer(code):
        if m["c"] is None and m["s"] is None:
            continue
        kind = "comment" if m["s"] is None else "string"
        raw, s, e = m[0], m.start(), m.end()
        text = clean_comment(raw) if kind == "comment" else string_text(raw, fam)
        if out and out[-1][0] == kind:
            between = code[out[-1][2] : s]
            if between.strip() in (("", "+", "\\", "..") if kind == "string" else ("",)):
                if kind == "string" and "\n\n" not in between:
                    out[-1] = (kind, out[-1][1], e, out[-1][3] + text)
                    continue
                own = code.rfind("\n", 0, out[-1][1]) + 1
                if kind == "comment" and between.count("\n") == 1 and raw[:2] != "/*" and not code[own : out[-1][1]].strip():
                    out[-1] = (kind, out[-1][1], e, out[-1][3] + "\n" + text)
                    continue
        out.append((kind, s, e, text))
    return out


_TAG = re.compile(r"^[@\\](?:t?param(?:\[[a-z, ]+\])?|arg|throws|exception|template)\s+[\w.$]+[ \t:-]*|^[@\\][A-Za-z]+(?:\{[^}]*\})?[ \t:]*|^:(?:param|type|raises|return|returns|rtype)(?: [\w.]+)*:[ \t]*|^(?:Args|Returns|Raises|Parameters|Yields):\s*$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^\s])|(?<=[。！？])")


def units(text: str) -> list[tuple[str, str]]:
    """(tag, sentence) of a comment or string: lines are joined unless a sentence, a tag or a list item begins."""
    out: list[tuple[str, str]] = []
    tag, buf = "", ""

    def flush():
        if buf.strip():
            out.extend((tag, x.strip()) for x in _SENTENCE.split(buf) if x and x.strip())

    for line in text.split("\n"):
        line = line.strip()
        m = _TAG.match(line)
        if m:
            flush()
            tag, buf = re.sub(r"\W", " ", m[0]).split()[0].lower(), line[m.end() :]
        elif not line or re.match(r"[-*+•]\s|\d+[.)]\s", line):
            flush()
            tag, buf = ("" if not line else tag), line
        else:
            wide = buf and (ord(buf[-1]) > 0x2E80 or ord(line[0]) > 0x2E80)
            buf = buf + ("" if wide or not buf else " ") + line
    flush()
    return out


_CJK = re.compile(r"[ぁ-ヿ㐀-䶿一-鿿々〆ー]")
_WORD = re.compile(r"""^[("'«„“‘¿¡\[*]*[^\W\d_]+(?:['’‐-][^\W\d_]+)*[.,;:!?)"'»“”’…\]*]*$""")
_INLINE = re.compile(r"`[^`\n]*`|\{@(?:code|link)[^}]*\}|https?://\S+|%[-+0-9.]*l{0,2}[a-zA-Z]\b|\{[\w:.]*\}|\$\{[^}]*\}|%\([a-z_]+\)s")
_QUERY = re.compile(r"^\s*(?:SELECT\b.+\bFROM\b|INSERT\s+INTO\b|UPDATE\s+\w+\s+SET\b|DELETE\s+FROM\b|CREATE\s+(?:TABLE|INDEX|VIEW)\b|DROP\s+TABLE\b|ALTER\s+TABLE\b|WITH\s+\w+\s+AS\b)", re.S)
_CODE = re.compile(
    r"^\s*(?:#\s*include|import\s+[\w.]+;?$|from\s+[\w.]+\s+import\b|using\s+namespace|package\s+[\w.]+;?$|return\b.*;$|def\s+\w+\(|class\s+\w+\s*[:{]|for\s+\w+(?:,\s*\w+)*\s+in\s+\S+:|(?:if|while)\s*\(|(?:if|elif|while)\s+[\w.]+(?:\s*[=<>!]=?\s*\S+)?:$)"
    r"|[;{}]\s*$|^[\w.:>-]+\([^)]*\)\s*;?\s*$|^\s*[\w.\[\]]+\s*[-+*/|&]?=\s*\S|[=!]==?|&&|\|\||=>|::\w+\(|^\s*--?\w"
)


def is_code(s: str) -> bool:
    """Whether a unit is a statement, query, pattern, path or key rather than text."""
    if _QUERY.search(s):
        return True
    s = re.sub(r"\{[\w:.]*\}", "", s)
    return bool(_CODE.search(s)) and not re.search(r"[\w)»”\"'][.!?]\s*$", s)


def running_text(s: str) -> str | None:
    """The words of a unit if it is a sentence or phrase, else None.

    At least three words, or six characters of Chinese or Japanese; identifiers,
    calls, paths, placeholders and inline code are no words.
    """
    wide = len(_CJK.findall(s))
    if wide >= 6:
        return None if is_code(s) and wide < 0.3 * len(s) else s
    if is_code(s):
        return None
    chunks = _INLINE.sub(" ", s).split()
    words = [c for c in chunks if _WORD.match(c)]
    if len(words) < 3 or 2 * len(words) < len(chunks):
        return None
    letters = [re.sub(r"[^\w'’-]", "", w) for w in words]
    if sum(len(w) > 1 for w in letters) < 3 or sum(bool(re.search(r"[a-zß-ÿа-я][A-ZА-Я]", w)) for w in letters) * 2 > len(letters):
        return None
    return " ".join(words)


def name_words(name: str | None) -> set[str]:
    """Words of an identifier, lower case, with and without their digits."""
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+", name or "")
    full = re.split(r"_|::|\.", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name or ""))
    return {x.lower() for x in [*parts, *full] if x}
