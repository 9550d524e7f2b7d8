"""Symbols and edges of C++ sources: a lexer and a scanner of declarations by balanced brackets.

No grammar is used; a scope is read statement by statement. A statement ends at a
semicolon or with a body in braces, and its head (the text before) tells what it
declares. Bodies of functions are searched for calls only.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

#: Names before a bracket that are no calls.
NO_CALL = {"if", "for", "while", "return", "switch", "sizeof", "static_cast", "reinterpret_cast", "dynamic_cast", "const_cast"}
BAD_NAME = ("HEDLEY", "DEPRECATED")
_SPECIFIERS = {"static", "inline", "virtual", "explicit", "constexpr", "consteval", "constinit", "extern", "friend", "typedef", "mutable", "thread_local", "register", "const", "volatile", "typename", "struct", "class", "enum", "unsigned", "signed", "long", "short"}
_SKIP = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|R"([^(\s"]{0,16})\(.*?\)\1"|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|^[ \t]*\#(?:\\\r?\n|[^\n])*', re.S | re.M)
_OPEN, _CLOSE = "([{", ")]}"


@dataclass
class Symbol:
    """A declared thing; ``definition`` holds its comments and whole source lines."""

    name: str
    kind: str
    definition: str
    line_start: int
    line_end: int
    signature: str | None = None
    parent_class: str | None = None

    @property
    def content_hash(self) -> str:
        return hashlib.sha256(self.definition.encode()).hexdigest()


@dataclass
class Result:
    """Symbols of a file and their edges: (ordinal of the source, kind, target text, ordinal of the target or None)."""

    symbols: list[Symbol] = field(default_factory=list)
    edges: list[tuple[int, str, str, int | None]] = field(default_factory=list)


def blank(source: str) -> str:
    """The source with comments, strings and preprocessor lines blanked, so that offsets and lines stay."""

    def one(m):
        s = m[0]
        keep = s[0] + s[-1] if s[0] in "\"'" and len(s) > 1 else None
        if keep:
            return keep[0] + re.sub(r"[^\n]", " ", s[1:-1]) + keep[1]
        return re.sub(r"[^\n]", " ", s)

    return _SKIP.sub(one, source)


def match_bracket(code: str, at: int, end: int) -> int:
    """Offset behind the bracket that closes the one at ``at``; ``end`` if none does."""
    depth = 0
    for i in range(at, end):
        if code[i] in _OPEN:
            depth += 1
        elif code[i] in _CLOSE:
            depth -= 1
            if depth <= 0:
                return i + 1
    return end


def _angle(code: str, at: int, end: int) -> int:
    """Offset behind a template bracket."""
    depth, i = 0, at
    while i < end:
        c = code[i]
        if c == "<":
            depth += 1
        elif c == ">" and code[i - 1] != "-":
            depth -= 1
            if not depth:
                return i + 1
        elif c in "([{":
            i = match_bracket(code, i, end)
            continue
        elif c in ";}":
            return at
        i += 1
    return at


def squeeze(s: str) -> str:
    return " ".join(s.split())


class Extractor:
    """One file. ``descend_macros``: also read what stands between conditional directives (the directives themselves are blank)."""

    def __init__(self, source: str, descend_macros: bool = True):
        self.source = source
        self.lines = source.split("\n")
        self.code = blank(source if descend_macros else _drop_conditionals(source))
        self.starts = [0]
        for x in self.lines:
            self.starts.append(self.starts[-1] + len(x) + 1)
        self.out = Result()

    def run(self) -> Result:
        self.scope(0, len(self.code), None)
        return self.out

    # positions -------------------------------------------------------------
    def line(self, at: int) -> int:
        lo, hi = 0, len(self.starts) - 1
        while lo + 1 < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.starts[mid] <= at else (lo, mid)
        return lo

    def text(self, a: int, b: int) -> tuple[str, int, int]:
        """Whole lines of a span, and its first and last line, from 1."""
        first, last = self.line(a), self.line(max(a, b - 1))
        return "\n".join(x.rstrip("\r") for x in self.lines[first : last + 1]), first + 1, last + 1

    def comments(self, a: int) -> str:
        """Documentation lines right above an offset; blank lines are skipped, any other text ends them."""
        kept: list[str] = []
        for i in range(self.line(a) - 1, -1, -1):
            t = self.lines[i].strip()
            if not t:
                continue
            if t.startswith(("///", "//!", "/**")) or t == "*/":
                kept.append(t)
            else:
                break
        return "".join(x + "\n" for x in reversed(kept))

    def add(self, name: str, kind: str, a: int, b: int, signature: str | None, parent: str | None, documented: bool = True) -> int:
        body, first, last = self.text(a, b)
        self.out.symbols.append(Symbol(name, kind, (self.comments(a) if documented else "") + body, first, last, signature, parent))
        return len(self.out.symbols) - 1

    # scopes ----------------------------------------------------------------
    def scope(self, a: int, end: int, parent: str | None) -> None:
        code, i = self.code, a
        while i < end:
            c = code[i]
            if c.isspace() or c in ";}":
                i += 1
                continue
            m = re.compile(r"(?:public|private|protected|signals|Q_SIGNALS|(?:public|private|protected)\s+slots)\s*:(?!:)").match(code, i, end)
            if m:
                i = m.end()
                continue
            i = self.statement(i, end, parent)

    def statement(self, a: int, end: int, parent: str | None) -> int:
        """Read one declaration from ``a``; the offset behind it."""
        code = self.code
        m = re.compile(r"template\s*(?=<)").match(code, a, end)
        if m:
            b = _angle(code, m.end(), end)
            if b > m.end():
                return self.statement_at(self.skip(b, end), end, parent, a)
        return self.statement_at(a, end, parent, a)

    def skip(self, i: int, end: int) -> int:
        while i < end and self.code[i].isspace():
            i += 1
        return i

    def statement_at(self, a: int, end: int, parent: str | None, outer: int) -> int:
        code = self.code
        m = re.compile(r"(?:inline\s+)?namespace\b[^{;=]*\{").match(code, a, end) or re.compile(r'extern\s*"[^"]*"\s*\{').match(code, a, end)
        if m:
            b = match_bracket(code, m.end() - 1, end)
            self.scope(m.end(), b - 1, parent)
            return b
        if re.compile(r"template\s*<").match(code, a, end):
            return self.statement(a, end, parent)
        # head: up to a semicolon or a brace outside round and square brackets
        i, equals, par = a, False, None
        while i < end:
            c = code[i]
            if c == ";":
                self.declaration(a, i, i + 1, parent, par)
                return i + 1
            if c == "(" or c == "[":
                b = match_bracket(code, i, end)
                if c == "(" and par is None and not equals:
                    par = (i, b)
                i = b
                continue
            if c == "<" and re.search(r"\w\s*$", code[a:i]) and not re.search(r"\boperator\s*<?$", code[a:i]):
                b = _angle(code, i, end)
                if b > i:
                    i = b
                    continue
            if c == "=" and par is None and not re.search(r"\boperator\s*[=!<>+*/%&|^-]?$", code[a:i]):
                equals = True
            if c == "{":
                return self.braced(a, i, end, parent, par, equals)
            if c == "}":
                return i + 1
            i += 1
        return end

    def braced(self, a: int, brace: int, end: int, parent: str | None, par, equals: bool) -> int:
        """A head with a body in braces."""
        code = self.code
        head = code[a:brace]
        close = match_bracket(code, brace, end)
        t = re.match(r"\s*(?:typedef\s+)?(?:(?:static|const|inline|constexpr|extern|friend)\s+)*(class|struct|union|enum(?:\s+(?:class|struct))?)\b", head)
        if t and not equals and (par is None or re.search(r"\b(?:alignas|__attribute__|__declspec)\s*$", code[a : par[0]])):
            stop = self.tail(close, end)
            rest = head[t.end() :]
            rest = re.sub(r"\[\[.*?\]\]|\b(?:alignas|__attribute__|__declspec)\s*\((?:[^()]|\([^()]*\))*\)", " ", rest)
            if t[1].startswith("enum"):
                n = re.match(r"\s*([\w:]+)", rest)
                self.add(n[1] if n else "anonymous", "enum", a, stop, None, parent)
            elif t[1] in ("class", "struct"):
                self.klass(t[1], rest, a, brace, close, stop)
            else:
                self.scope(brace + 1, close - 1, parent)
            return stop
        if par is not None and not equals:
            # constructor initialisers may hold braces of their own before the body
            body, stop = brace, close
            if re.search(r"\)\s*(?:noexcept\s*)?:[^:]", code[par[1] - 1 : brace + 1] + " ") or re.match(r"\s*:(?!:)", code[par[1] : brace]):
                while True:
                    nxt = self.skip(stop, end)
                    if nxt < end and code[nxt] == ",":
                        b = code.find("{", nxt, end)
                        p = code.find("(", nxt, end)
                        at = min(x for x in (b, p, end) if x >= 0)
                        stop = match_bracket(code, at, end)
                        continue
                    if nxt < end and code[nxt] == "{":
                        body, stop = nxt, match_bracket(code, nxt, end)
                        continue
                    break
            self.function(a, par, body, stop, parent)
            return stop
        stop = self.tail(close, end)
        self.declaration(a, brace, stop, parent, par)
        return stop

    def tail(self, i: int, end: int) -> int:
        """Offset behind the semicolon that ends a declaration after its body."""
        m = re.compile(r"[^;{}()]*;").match(self.code, i, end)
        return m.end() if m else i

    # declarations ----------------------------------------------------------
    def klass(self, kind: str, rest: str, a: int, brace: int, close: int, stop: int) -> None:
        head, _, bases = re.sub(r"::", "\0", rest).partition(":")
        names = re.findall(r"[\w\0]+", head.split("<")[0].replace(" final", " "))
        name = names[-1].replace("\0", "::") if names else "anonymous"
        ordinal = self.add(name, kind, a, stop, name, None)
        for base in _commas(bases.replace("\0", "::")):
            base = squeeze(re.sub(r"\b(?:public|private|protected|virtual)\b", " ", base))
            if base:
                self.out.edges.append((ordinal, "inherits", base, None))
        self.scope(brace + 1, close - 1, name)

    def owner(self, parent: str | None) -> int | None:
        return next((i for i, s in enumerate(self.out.symbols) if s.name == parent), None) if parent else None

    def contain(self, parent: str | None, bare: str, ordinal: int) -> None:
        own = self.owner(parent)
        if own is not None:
            self.out.edges.append((own, "contains", bare, ordinal))

    def function(self, a: int, par: tuple[int, int], body: int, stop: int, parent: str | None) -> None:
        head = self.code[a : par[0]]
        m = re.search(r"((?:[\w~]+(?:\s*<[^<>;{}]*>)?\s*::\s*)*(?:operator\s*(?:\(\s*\)|[^\s\w(]+|[\w\s*&]+?)|~?\w+))\s*$", head)
        name = squeeze(m[1]) if m else ""
        kind_text = squeeze(head[: m.start()]) if m else squeeze(head)
        if not name or name.startswith("(") or any(x in name for x in BAD_NAME):
            name = parent or next((w for w in re.findall(r"\w+", kind_text) if w not in _SPECIFIERS), "")
        if not name or "HEDLEY" in name:
            name = "anon"
        full = f"{parent}::{name}" if parent else name
        ordinal = self.add(full, "method" if parent else "function", a, stop, full, parent)
        self.contain(parent, name, ordinal)
        returns = self.type_of(kind_text)
        if returns and returns != "void" and not (parent and name in (parent, f"~{parent}")):
            self.out.edges.append((ordinal, "returns", returns, None))
        for p in _commas(self.code[par[0] + 1 : par[1] - 1]):
            t = self.param_type(p)
            if t:
                self.out.edges.append((ordinal, "param_type", t, None))
        whole = self.source[a:stop]
        if parent and "override" in whole and "override default" not in whole:
            self.out.edges.append((ordinal, "overrides", name, None))
        self.calls(ordinal, body, stop)

    def calls(self, ordinal: int, a: int, b: int) -> None:
        for m in re.compile(r"((?:\b[A-Za-z_]\w*(?:\s*<[\w\s:,*&<>]*>)?(?:\([^()]*\)|\[[^\[\]]*\])?\s*(?:::|\.|->)\s*)*~?\b[A-Za-z_]\w*(?:\s*<[\w\s:,*&]*>)?)\s*\(").finditer(self.code, a, b):
            name = m[1].strip()
            before = self.code[:m.start()].rstrip()[-1:]
            head = name.split("<")[0].strip()
            declared = re.search(r"[\w>&*]\s+[&*]*$", self.code[max(0, m.start() - 40) : m.start()])
            word = re.search(r"(\w+)\s+$", self.code[max(0, m.start() - 40) : m.start()])
            if declared and not (word and word[1] in ("return", "else", "do", "co_return", "co_await", "throw", "case", "and", "or", "not", "new")) and before not in "=(,;{}&|!+-/?:<%^~" and "::" not in name and "." not in name and "->" not in name:
                continue  # a variable with an initialiser
            if len(name.encode()) > 1 and head not in NO_CALL and head not in ("catch", "alignof", "decltype", "noexcept", "defined"):
                self.out.edges.append((ordinal, "calls", name, None))

    @staticmethod
    def type_of(text: str) -> str:
        """Type of a declaration's head without storage words and declarator signs."""
        t = re.sub(r"\[\[.*?\]\]|\b(?:static|inline|virtual|explicit|constexpr|consteval|constinit|extern|friend|typedef|mutable|thread_local|register|const|volatile|typename)\b", " ", text)
        return squeeze(re.sub(r"[*&\s]+$", "", t))

    def param_type(self, p: str) -> str | None:
        """Type of a parameter; one with a default value, ``...`` and ``void`` give none."""
        if re.search(r"(?<![=!<>])=(?!=)", p) or not p.strip() or "..." in p:
            return None
        t = self.type_of(p)
        m = re.match(r"(?:(?:struct|class|enum)\s+)?(?:(?:(?:unsigned|signed|long|short)\b\s*)+(?:(?:int|char|double)\b)?|[\w:]+(?:\s*<.*>(?:::\w+)*)?)", t)
        t = squeeze(m[0]) if m else t
        return None if t in ("", "void") else t

    def declaration(self, a: int, head_end: int, stop: int, parent: str | None, par) -> None:
        """A statement without a function body: field, variable or prototype; using, friend and the like are passed over."""
        head = self.code[a:head_end]
        if not head.strip() or re.match(r"\s*(?:using|friend|typedef|static_assert|template|return|goto|#)\b", head) or re.match(r"\s*(?:class|struct|union|enum(?:\s+class)?)\s+[\w:]+\s*(?::\s*[\w:]+\s*)?$", head):
            return
        src = self.source[a:head_end] if stop - head_end <= 1 else self.source[a : stop - 1]
        blanked = self.code[a : a + len(src)]
        if parent:
            cut = _top(blanked, "=")
            brace = _top(blanked, "{")
            cut = min(x for x in (cut, brace, len(blanked)) if x >= 0)
            decl_type, name = _split_declarator(_commas(blanked[:cut])[0])
            name = squeeze(name) or "?"
            full = f"{parent}::{name}"
            t = self.type_of(decl_type)
            ordinal = self.add(full, "field", a, stop, f"{full}: {t}", parent)
            self.contain(parent, name, ordinal)
            if t:
                self.out.edges.append((ordinal, "field_type", t, None))
            return
        first = _commas(blanked)[0] if "(" not in blanked.split("=")[0] else blanked
        _, name = _split_declarator(first)
        if not name:
            return
        offset = first.rfind(name)
        self.add(squeeze(src[offset : len(first)]) or "?", "variable", a, stop, None, None, documented=False)


def _drop_conditionals(source: str) -> str:
    """The source without what stands inside conditional directives."""
    out, depth = [], 0
    for x in source.split("\n"):
        d = re.match(r"\s*#\s*(if|ifdef|ifndef|endif)\b", x)
        if d and d[1] == "endif":
            depth = max(0, depth - 1)
            out.append("")
        elif d:
            depth += 1
            out.append("")
        else:
            out.append("" if depth else x)
    return "\n".join(y.ljust(len(x)) for x, y in zip(source.split("\n"), out))


def _commas(s: str) -> list[str]:
    """Parts of a list at its commas outside brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(s):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or (c == ">" and (not i or s[i - 1] != "-")):
            depth -= 1
        elif c == "," and depth <= 0:
            out.append(s[last:i])
            last = i + 1
    return [*out, s[last:]]


def _top(s: str, sign: str) -> int:
    """First place of a sign outside brackets, -1 without one."""
    depth = 0
    for i, c in enumerate(s):
        if c == sign and not depth:
            return i
        if c in "([<":
            depth += 1
        elif c in ")]>":
            depth -= 1
    return -1


def _split_declarator(s: str) -> tuple[str, str]:
    """(type, declarator) of a declaration: the declarator is the last name with what is bound to it."""
    s = s.rstrip()
    m = re.search(r"([*&\s]*)((?:[\w~]+\s*::\s*)*(?:operator\s*[^\s\w(]+|~?[A-Za-z_]\w*))\s*(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)[^()=]*|(?:\[[^\]]*\]\s*)*|:\s*\d+\s*)?(?:=.*)?$", s, re.S)
    if not m:
        return s, ""
    return s[: m.start()], squeeze(m[2] + (m[3] or "").rstrip())


def extract(source: str, language: str | None = "cpp", descend_macros: bool = True) -> Result:
    """Symbols and edges of a source text; languages other than C++ give none."""
    if language != "cpp" or not source:
        return Result()
    return Extractor(source, descend_macros).run()
