"""Clean text out of HTML, Markdown, wiki and LaTeX markup, keeping headings, lists, code blocks, tables and formulas.

A text is read as a tree of HTML elements (unknown names in angle brackets are
text); what stands between tags is read line by line for the three line-based
notations. Paragraphs pass points for their length and commas to their
ancestors, discounted by the share of their text that is links; the best
container and its siblings are kept, so menus and link lists around the real
text go. A text without containers is one container and is kept whole.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names. Those of the last set are everyday words and count only with a partner or an attribute.
BLOCK = set("p div table tr tbody thead tfoot ul ol li dl dt dd blockquote pre h1 h2 h3 h4 h5 h6 hr section article aside header footer nav main form figure body html head center fieldset".split())
INLINE = set("a b i u s q em strong span code tt kbd samp sub sup img br font strike del ins small big abbr cite td th caption iframe input mark wbr ref nowiki math syntaxhighlight gallery blockquote".split())
WORDS = set("section article aside header footer nav main form figure body html head center title style script link meta map data time object label option select source base button frame menu output param picture progress track summary template var video audio canvas dialog details address area caption cite mark small big input font gallery math ref figcaption svg path noscript textarea".split())
VOID = {"br", "hr", "img", "input", "wbr", "meta", "link", "source", "area", "base", "param", "track"}
ATTRIBUTES = {"nodiscard", "maybe_unused", "deprecated", "fallthrough", "noreturn", "likely", "unlikely", "no_unique_address", "carries_dependency", "assume"}
NOT_SHOWN = {"script", "style", "head", "noscript", "template"}

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?)*)\s*(/?)>")
_COMMENT = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>|<\?xml.*?\?>|<!\[CDATA\[|\]\]>", re.S | re.I)
_CODE_SPAN = re.compile(r"^[ \t]{0,3}(```+|~~~+)[^\n]*\n.*?(?:^[ \t]{0,3}\1[ \t]*$|\Z)|(?<!`)`[^`\n]+`(?!`)|^\{(code|noformat)[^}\n]*\}[ \t]*\n.*?^\{\2\}", re.S | re.M)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")

_FENCE = re.compile(r"^\s{0,3}(?:(```+|~~~+)[^`]*$|\{(?:code|noformat)(?::[^}]*)?\}\s*$|\\begin\{(?:verbatim|lstlisting|minted)\}.*$)")
_FENCE_END = {"`": re.compile(r"^\s{0,3}```+\s*$"), "~": re.compile(r"^\s{0,3}~~~+\s*$"), "{": re.compile(r"^\s*\{(?:code|noformat)\}\s*$"), "\\": re.compile(r"^\s*\\end\{(?:verbatim|lstlisting|minted)\}\s*$")}
_MATH_ENV = re.compile(r"\\begin\{((?:equation|align|gather|multline|eqnarray|displaymath|math)\*?)\}(.*?)\\end\{\1\}", re.S)
_HEADING = re.compile(r"^\s{0,3}(#{1,6})\s+(\S.*?)\s*#*\s*$")
_WIKI_HEADING = re.compile(r"^\s*(={2,6})\s*([^=\s].*?)\s*\1\s*$")
_TEX_HEADING = re.compile(r"^\s*\\((?:sub)*section|chapter|part|(?:sub)?paragraph)\*?\{(.*)\}\s*$")
_JIRA_HEADING = re.compile(r"^h([1-6])\.\s+(\S.*)$")
_UNDERLINE = re.compile(r"^\s{0,3}(={3,}|-{3,}|\^{3,}|~{4,}|\*{3,})\s*$")
_TABLE_RULE = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$|^\s*\|\s*:?-{2,}:?\s*\|\s*$")
_TABLE_ROW = re.compile(r"^\s*\|(?![-}+|]).*\|\s*$")
_WIKI_TABLE = re.compile(r"^\s*(?:\{\|.*|\|\}|\|-+.*|\|\+.*)$")
_WIKI_CELL = re.compile(r"^\s*[|!]\s*\S.*?(?:\|\||!!).*$")
_STAR = re.compile(r"^(\s*)((?:\*[*#:;]*|\#[*#:]+|\+)|(?:[-*+]|\d+[.)])\s+\[[ xX]\])\s+(?=\S)")
_QUOTE = re.compile(r"^\s{0,3}>(?!>>)\s?(?=\S|$)")
_REF_DEF = re.compile(r"^\s{0,3}\[(?!\^)([^\]\n]{1,80})\]:\s+\S+.*$")
_NOTE_DEF = re.compile(r"^\s{0,3}\[\^[\w-]+\]:\s*")
_CATEGORY = re.compile(r"^\s*\[\[(?:Category|Kategorie|Catégorie|Categoría|Категория|分类|カテゴリ):[^\]]*\]\]\s*$", re.I)
_ITEM = re.compile(r"\\item(?:\[[^\]]*\])?(?=\s|$)")
_TEX_ENV = re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]]*\])?")
_TEX_CMD = re.compile(r"\\(label|cite[a-z]*|ref|eqref|pageref|bibliography|usepackage|documentclass|includegraphics)\*?(?:\[[^\]]*\])?\{[^{}]*\}(?:\{[^{}]*\})?")
_TEX_TEXT = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}")
_TEX_SWITCH = re.compile(r"\{\\(?:tt|bf|it|em|sc|sl|rm|sf|small|large)\b\s*([^{}]*)\}")
_MATH = (re.compile(r"\$\$(?=\S)(.+?)\$\$", re.S), re.compile(r"\\\[(.+?)\\\]", re.S), re.compile(r"\\\((.+?)\\\)", re.S))
_MATH_1 = re.compile(r"(?<![A-Za-z0-9_$\\])\$(?=[^\s$\d])([^$\n]*?[^\s$\\])\$(?![A-Za-z0-9_$])|(?<![A-Za-z0-9_$\\])\$(?=\d)([^$\n]*?[\\^_=+][^$\n]*?[^\s$\\])\$(?![A-Za-z0-9_$])")
_MATHY = re.compile(r"[\\^_=+<>]|^[A-Za-z]$|\w\(\w|\d\s*[A-Za-z]|[A-Za-z]\s*[-*/]\s*[A-Za-z]")

_INLINE_RULES: list[tuple[re.Pattern, str, str]] = [
    (re.compile(r"``(?=\S)(.+?)``|(?<!`)`([^`\n]+)`(?!`)"), r"\1\2", "markdown"),
    (re.compile(r"!\[([^\]\n]*)\]\([^)\n]*\)"), r"\1", "markdown"),
    (re.compile(r"\[([^\[\]\n]+)\]\((?=[^)\s]*[./#:])[^)\s]+(?:\s+\"[^\"]*\")?\)"), r"\1", "markdown"),
    (re.compile(r"(?<![A-Za-z0-9_)\]\[])\[(?=[^\[\]\n]*[^\W\d_])([^\[\]\n]+)\]\[(?=[^\[\]\n]*[^\W\d_]{2})[^\[\]\n]*\](?!\[)"), r"\1", "markdown"),
    (re.compile(r"\[\^[\w-]+\]"), "", "markdown"),
    (re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>"), r"\1", "markdown"),
    (re.compile(r"\[\[(?:File|Image|Datei|Fichier|Archivo|Файл|文件|ファイル):[^\]|]*(?:\|[^\]|]*)*?\|?([^\]|]*)\]\]", re.I), r"\1", "wiki"),
    (re.compile(r"\[\[(?:[^\[\]|\n]+\|)?([^\[\]|\n]+)\]\]"), r"\1", "wiki"),
    (re.compile(r"\[(?:https?|ftp)://[^\s\]]+\s+([^\]\n]+)\]"), r"\1", "wiki"),
    (re.compile(r"\{\{[^\W\d_][^{}|\n]*((?:\|[^{}\n]*)?)\}\}"), r"\1", "wiki"),
    (re.compile(r"'''''(?=\S)(.+?)'''''|'''(?=\S)(.+?)'''|(?<!')''(?=[^\s'])([^'\n](?:(?!'').)*?)''(?!')"), r"\1\2\3", "wiki"),
    (re.compile(r"(?<![*A-Za-z0-9_\\])\*\*\*(?=[^\s*])(.+?)(?<=[^\s*])\*\*\*(?!\*)"), r"\1", "markdown"),
    (re.compile(r"(?<![*\\])\*\*(?=[^\s*])([^*\n]*?(?:\*[^*\n]+\*[^*\n]*?)?)(?<=[^\s*])\*\*(?!\*)"), r"\1", "markdown"),
    (re.compile(r"(?<!_)___(?=[^\s_])([^_\n]+?)(?<=\S)___(?!_)"), r"\1", "markdown"),
    (re.compile(r"(?<![A-Za-z0-9_])__(?=[^\s_])([^_\n]*?[^\w\n][^_\n]*?|[^_\n]*[^\x00-\x7f][^_\n]*)(?<=[^\s_])__(?![A-Za-z0-9_])"), r"\1", "markdown"),
    (re.compile(r"~~(?=[^\s~])([^~\n]+?)(?<=\S)~~"), r"\1", "markdown"),
    (re.compile(r"(?<![*A-Za-z0-9_\\(/])\*(?=[^\s*)\]])([^*\n]*?[^\s*(\[])\*(?![*A-Za-z0-9_(])"), r"\1", "markdown"),
    (re.compile(r"(?<![A-Za-z0-9_\\./-])_(?=[^\s_])([^_\n]*?[^\s_])_(?![A-Za-z0-9_./(-])"), r"\1", "markdown"),
]


class Marks(dict):
    """Number of marks of each notation that were resolved."""

    def hit(self, kind: str, n: int = 1) -> None:
        self[kind] = self.get(kind, 0) + n


def _entities(s: str, marks: Marks) -> str:
    def one(m):
        if m[1] and f"{m[1]};" not in html5:
            return m[0]
        marks.hit("html")
        return html.unescape(m[0]).replace("\xa0", " ")

    return _ENTITY.sub(one, s) if "&" in s else s


def inline(s: str, marks: Marks) -> str:
    """Text of a line without the marks inside it; formulas keep their source without the dollar signs."""
    held: list[str] = []

    def hold(body: str) -> str:
        held.append(body.strip())
        return f"\x00{len(held) - 1}\x00"

    def math(m):
        body = next(g for g in m.groups() if g is not None)
        if m.re is _MATH_1 and not _MATHY.search(body):
            return m[0]
        if m.re in _MATH[1:] and not _MATHY.search(body):
            return m[0]
        marks.hit("latex")
        return hold(body)

    if "`" in s:

        def code(m):
            marks.hit("markdown")
            return hold(m[1] or m[2])

        s = _INLINE_RULES[0][0].sub(code, s)
    if "$" in s or "\\" in s:
        for rule in (*_MATH, _MATH_1):
            s = rule.sub(math, s)
        s, n = _TEX_CMD.subn("", s)
        if n:
            marks.hit("latex", n)
            s = re.sub(r"~(?=\s|$|[.,;:)])", "", s).replace("~", " ") if "~" in s and "~~" not in s else s
        for _ in range(4):
            s, n = _TEX_TEXT.subn(r"\1", s)
            s, k = _TEX_SWITCH.subn(r"\1", s)
            if not n + k:
                break
            marks.hit("latex", n + k)
    if not _SIGNS.isdisjoint(s):
        for rule, to, kind in _INLINE_RULES[1:]:

            def put(m, to=to, kind=kind):
                if kind == "wiki" and m[0].startswith("[[") and m[m.lastindex or 0].strip().split("(")[0] in ATTRIBUTES:
                    return m[0]
                marks.hit(kind)
                t = m.expand(to)
                return t.lstrip("|").replace("|", " ") if m[0].startswith("{{") else t

            s = rule.sub(put, s)
    s = _entities(s, marks)
    return re.sub(r"\x00(\d+)\x00", lambda m: held[int(m[1])], s)


_SIGNS = frozenset("*_~[{'<!`")
Block = tuple[str, int, str]


def _lines(text: str, marks: Marks, out: list[Block]) -> None:
    """Blocks (kind, level, text) of a text in line-based notation; kinds: heading, text, item, code, formula, table."""

    def env(m):
        marks.hit("latex")
        return "\n\x01" + re.sub(r"\s*\n\s*", " ", m[2].strip()) + "\n"

    if "\\begin" in text:
        text = _MATH_ENV.sub(env, text)
    lines = text.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        bare = line.strip()
        i += 1
        if not bare:
            out.append(("gap", 0, ""))
            continue
        if bare[0] == "\x01":
            out.append(("formula", 0, bare[1:]))
            continue
        m = _FENCE.match(line)
        if m:
            end = _FENCE_END[bare[0]]
            j = next((k for k in range(i, len(lines)) if end.match(lines[k])), len(lines))
            if j < len(lines) or bare[0] in "`{\\":
                kind = {"{": "wiki", "\\": "latex"}.get(bare[0], "markdown")
                marks.hit(kind)
                out.append(("code", 0, "\n".join(lines[i:j])))
                i = j + 1
                continue
        m = _HEADING.match(line)
        if m:
            marks.hit("markdown")
            out.append(("heading", len(m[1]), inline(m[2], marks)))
            continue
        m = _WIKI_HEADING.match(line)
        if m:
            marks.hit("wiki")
            out.append(("heading", len(m[1]), inline(m[2], marks)))
            continue
        m = _TEX_HEADING.match(line)
        if m:
            marks.hit("latex")
            out.append(("heading", 1 + m[1].count("sub"), inline(m[2], marks)))
            continue
        m = _JIRA_HEADING.match(line)
        if m:
            marks.hit("wiki")
            out.append(("heading", int(m[1]), inline(m[2], marks)))
            continue
        m = _UNDERLINE.match(line)
        if m:
            marks.hit("markdown")
            if out and out[-1][0] == "text" and m[1][0] in "=-^~":
                out[-1] = ("heading", 1 if m[1][0] == "=" else 2, out[-1][2])
            continue
        if _TABLE_RULE.match(line):
            marks.hit("markdown")
            if out and out[-1][0] == "text" and "|" in out[-1][2]:
                out[-1] = ("table", 0, out[-1][2].replace("|", "\t"))
            continue
        if _CATEGORY.match(line):
            marks.hit("wiki")
            continue
        if _WIKI_TABLE.match(line):
            marks.hit("wiki")
            continue
        if _WIKI_CELL.match(line):
            marks.hit("wiki")
            out.append(("table", 0, "\t".join(inline(c.strip(), marks) for c in re.split(r"\|\||!!", bare[1:]))))
            continue
        if _TABLE_ROW.match(line):
            marks.hit("markdown")
            out.append(("table", 0, "\t".join(inline(c.strip(), marks) for c in bare.strip("|").split("|"))))
            continue
        if _REF_DEF.match(line):
            marks.hit("markdown")
            continue
        n = _NOTE_DEF.match(line)
        if n:
            marks.hit("markdown")
            out.append(("text", 0, inline(line[n.end() :], marks)))
            continue
        if _ITEM.search(line) or _TEX_ENV.search(line):
            marks.hit("latex")
            item = bool(_ITEM.search(line))
            rest = _TEX_ENV.sub("", _ITEM.sub("", line)).strip()
            if rest:
                out.append(("item" if item else "text", 0, inline(rest, marks)))
            continue
        q = _QUOTE.match(line)
        if q:
            marks.hit("markdown")
            while q:
                line = line[q.end() :]
                q = _QUOTE.match(line)
            if not line.strip():
                continue
        m = _STAR.match(line)
        if m:
            marks.hit("wiki" if re.match(r"[*#]{2}", m[2]) else "markdown")
            out.append(("item", len(m[1]) // 2 + (len(m[2]) - 1 if "[" not in m[2] else 0), inline(line[m.end() :], marks)))
            continue
        m = re.match(r"^(\s*)(?:[-–•]|\d+[.)])\s+(?=\S)", line)
        t = inline(line[m.end() :] if m and m[0].strip()[0] in "-–•" else line.strip(), marks)
        out.append(("item" if m else "text", len(m[1]) // 2 if m else 0, t))


class Node:
    """Element of the tree; parts are texts (with whether they are link text) and elements, in order."""

    __slots__ = ("tag", "parent", "parts", "score", "total", "linked")

    def __init__(self, tag: str, parent: Node | None = None):
        self.tag, self.parent, self.parts, self.score, self.total, self.linked = tag, parent, [], 0.0, 0, 0

    def density(self) -> float:
        """Share of the text below that is links."""
        return self.linked / max(1, self.total)


def _counts(text: str, m: re.Match, closed: set[str]) -> bool:
    """Whether a match in angle brackets is an HTML tag."""
    name = m[2].lower()
    if name not in BLOCK and name not in INLINE and name not in WORDS:
        return False
    if m[3].strip() and "=" in m[3]:
        return True
    if m[3].strip():
        return False
    if name in WORDS and name not in ("center", "font"):
        return name in closed and not (m.start() and text[m.start() - 1] in "#:" or re.search(r"#include\s*$", text[max(0, m.start() - 40) : m.start()]))
    if len(name) == 1 and not m[1] and m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_:"):
        return name in closed
    return True


def _tree(text: str, marks: Marks) -> list[Node]:
    """Elements of a text, parents before children, the root first; what stands in code fences and inline code is no tag."""
    if "<" in text:
        code = [m.span() for m in _CODE_SPAN.finditer(text)]

        def in_code(at: int) -> bool:
            i = bisect_right(code, (at, len(text))) - 1
            return i >= 0 and code[i][0] <= at < code[i][1]

        def comment(m):
            if in_code(m.start()):
                return m[0]
            marks.hit("html")
            return ""

        text = _COMMENT.sub(comment, text)
        code = [m.span() for m in _CODE_SPAN.finditer(text)]
    else:
        in_code = bool
    closed = {m[2].lower() for m in _TAG.finditer(text) if m[1]} & {m[2].lower() for m in _TAG.finditer(text) if not m[1]}
    tags = [m for m in _TAG.finditer(text) if _counts(text, m, closed) and not in_code(m.start())]
    cur, at, link, pre, hidden = Node("root"), 0, 0, 0, 0
    nodes, open_ = [cur], Counter()
    for m in tags:
        marks.hit("html")
        piece = text[at : m.start()]
        at = m.end()
        if piece and not hidden:
            cur.parts.append((piece, bool(link), bool(pre)))
        name, closing = m[2].lower(), bool(m[1])
        if name == "a":
            link = max(0, link + (-1 if closing else 1))
        elif name in NOT_SHOWN:
            hidden = max(0, hidden + (-1 if closing else 1))
        elif name == "br":
            cur.parts.append(("\n", False, bool(pre)))
        elif name in ("td", "th"):
            if closing:
                cur.parts.append(("\t", False, True))
        elif name in BLOCK and name != "hr":
            if name == "pre":
                pre = max(0, pre + (-1 if closing else 1))
            if closing:
                while open_[name]:  # what is still open inside it is closed too
                    open_[cur.tag] -= 1
                    closed_tag, cur = cur.tag, cur.parent
                    if closed_tag == name:
                        break
            else:
                if name in ("li", "p", "tr") and cur.tag == name:
                    open_[name] -= 1
                    cur = cur.parent
                node = Node(name, cur)
                cur.parts.append(node)
                nodes.append(node)
                open_[name] += 1
                cur = node
    if not hidden:
        cur.parts.append((text[at:], bool(link), bool(pre)))
    for n in reversed(nodes):
        for p in n.parts:
            if isinstance(p, tuple):
                n.total += len(p[0])
                n.linked += len(p[0]) if p[1] else 0
        if n.parent:
            n.parent.total += n.total
            n.parent.linked += n.linked
    return nodes


def _score(nodes: list[Node]) -> set[int]:
    """Elements (by id) to leave out: outside the best container and its siblings."""
    for n in nodes:
        own = "".join(p[0] for p in n.parts if isinstance(p, tuple))
        if len(own.strip()) >= 25:
            points = 1 + len(re.findall(r"[,，、،;；]", own)) + min(len(own) / 100, 3)
            n.score += points
            if n.parent:
                n.parent.score += points
                if n.parent.parent:
                    n.parent.parent.score += points / 2
    for n in nodes:
        n.score *= 1 - n.density()
    best = max(nodes, key=lambda n: n.score)
    if best.score <= 0:
        return set()
    drop: set[int] = set()
    n = best
    while n.parent:
        for sib in n.parent.parts:
            if isinstance(sib, Node) and sib is not n:
                good = sib.score >= 0.2 * best.score or sib.density() < 0.5 or sib.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "pre", "table")
                if not good:
                    drop.add(id(sib))
        n = n.parent
    for p in best.parts:  # link lists inside the container
        if isinstance(p, Node) and p.tag in ("ul", "ol", "nav", "div") and p.density() > 0.8 and p.total > 0 and p.score < 0.2 * best.score:
            drop.add(id(p))
    return drop


def _render(root: Node, marks: Marks, drop: set[int]) -> list[Block]:
    """Blocks of a tree in order; elements of any depth, without recursion."""
    out: list[Block] = []

    def flush(n: Node, buf: list[str], depth: int) -> None:
        text = "".join(buf)
        buf.clear()
        if not text:
            return
        if n.tag == "pre":
            out.append(("code", 0, _entities(text, marks).strip("\n")))
        elif n.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            out.append(("heading", int(n.tag[1]), inline(" ".join(text.split()), marks)))
        elif n.tag == "tr":
            out.append(("table", 0, inline(text.strip(), marks)))
        elif n.tag in ("li", "dd", "dt"):
            out.append(("item", depth, inline(" ".join(text.split()), marks)))
        else:
            _lines(text, marks, out)

    stack: list[tuple[Node, object, list[str], int]] = [(root, iter(root.parts), [], 0)]
    while stack:
        n, parts, buf, depth = stack[-1]
        for p in parts:
            if isinstance(p, tuple):
                buf.append(p[0])
                continue
            flush(n, buf, depth)
            if id(p) not in drop:
                stack.append((p, iter(p.parts), [], depth + (n.tag in ("ul", "ol") and p.tag in ("ul", "ol"))))
                break
        else:
            flush(n, buf, depth)
            stack.pop()
    return out


def convert(text: str | None) -> tuple[str, list[Block], Marks]:
    """(clean text, blocks, marks by notation) of a text; NULL and empty give an empty text."""
    marks = Marks()
    if not text:
        return "", [], marks
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "").replace("\x01", "")
    nodes = _tree(text, marks)
    out = _render(nodes[0], marks, _score(nodes))
    blocks = [b for b in out if b[0] == "gap" or b[2].strip()]
    lines: list[str] = []
    for kind, level, t in blocks:
        if kind == "gap":
            lines.append("")
        elif kind == "heading":
            lines += ["", t, ""]
        elif kind == "item":
            lines.append("  " * level + (t if re.match(r"\d+[.)]\s", t) else f"- {t}"))
        elif kind == "code":
            lines += ["", *("    " + x for x in t.split("\n")), ""]
        elif kind == "formula":
            lines += ["", "    " + t, ""]
        else:
            lines.append(t)
    clean = re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in lines)).strip("\n")
    return clean, [b for b in blocks if b[0] != "gap"], marks


def convert_line(text: str | None) -> tuple[str, Marks]:
    """Clean text and marks of a title."""
    clean, _, marks = convert(text)
    return " ".join(clean.removeprefix("- ").split()), marks


_SCHEMA = "node_id long, clean_title string, clean_content string, blocks array<struct<kind: string, level: int, text: string>>, title_marks map<string, int>, content_marks map<string, int>"


def _rows(batches):
    kinds = pa.map_(pa.string(), pa.int32())
    block = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())]))
    for b in batches:
        ids, titles, contents = (c.to_pylist() for c in b.columns)
        t = [convert_line(x) for x in titles]
        c = [convert(x) for x in contents]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([x[0] for x in t], pa.string()),
                pa.array([x[0] for x in c], pa.string()),
                pa.array([[{"kind": k, "level": n, "text": s} for k, n, s in x[1]] for x in c], block),
                pa.array([list(x[1].items()) for x in t], kinds),
                pa.array([list(x[2].items()) for x in c], kinds),
            ],
            names=["node_id", "clean_title", "clean_content", "blocks", "title_marks", "content_marks"],
        )


def clean_documents(nodes: DataFrame) -> DataFrame:
    """Clean title and content of every row, its blocks in order, and the marks found, by notation (html, markdown, wiki, latex).

    NULL and empty fields give empty texts without marks; repeated rows come out repeated.
    """
    return nodes.select(F.col("id").cast("long").alias("id"), "title", "content").mapInArrow(_rows, _SCHEMA)


def marked_fields(cleaned: DataFrame) -> DataFrame:
    """node_id and node_field of the fields in which markup was resolved."""
    fields = F.array(*[F.struct(F.lit(f).alias("node_field"), F.col(f"{f}_marks").alias("marks")) for f in ("title", "content")])
    return cleaned.select("node_id", F.explode(fields).alias("f")).filter(F.size("f.marks") > 0).select("node_id", "f.node_field").distinct()
