"""Functions paired with their documentation comments.

One recursive pattern of the ``regex`` library takes the comments before a
function, its signature and its balanced body together; strings, characters and
comments are consumed as such, so brackets inside them do not count. What the
comment says is then weighed: pairs whose comment says nothing are dropped.
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrove.llm.lexing import RULES, clean_comment, family, is_code, name_words, running_text, units

def _recursive(fam: str) -> regex.Pattern:
    """Comments, signature and balanced body of a function, with the family's own comments and strings consumed as such."""
    rule = RULES[fam]
    skip = " | ".join(f"(?&{k})" for k in ("com", "str", "skip") if k in rule)
    return regex.compile(
        rf"""
        (?(DEFINE) {" ".join(f"(?P<{k}> {v} )" for k, v in rule.items())}
          (?P<par> \( (?: (?: [^()"'`/\w]++ | [A-Za-z_]\w*+(?!["'`]) )++ | {skip} | (?&par) | \w++ | ["'`/] )*+ \) )
          (?P<brace> \{{ (?: (?: [^{{}}"'`/\w]++ | [A-Za-z_]\w*+(?!["'`]) )++ | {skip} | (?&brace) | \w++ | ["'`/] )*+ \}} )
        )
        (?P<lead> (?: \s*+ (?&com) )*+ \s*+ )
        (?P<sig> (?: [^{{}};()"'`/]++ | (?&com) | (?&par) | (?&str) | / )*+ )
        (?P<body> (?&brace) | ; )
        """,
        regex.X,
    )


_C_LIKE = {fam: _recursive(fam) for fam in RULES if fam != "python"}
_PYTHON = regex.compile(
    r"""
    (?(DEFINE)
      (?P<str> [rRbBuUfF]{0,2} (?: \"\"\"(?:\\.|(?!\"\"\").)*+\"\"\" | '''(?:\\.|(?!''').)*+''' | "(?:\\.|[^"\\\n])*+" | '(?:\\.|[^'\\\n])*+' ) )
      (?P<par> [(\[{] (?: [^()\[\]{}"'\#]++ | (?&str) | \#[^\n]*+ | (?&par) )*+ [)\]}] )
    )
    (?P<lead> (?: [ \t]*+ (?: \#[^\n]*+ )? \n )*+ )
    (?P<sig> (?: [ \t]*+ [@\#][^\n]*+ \n )*+ [ \t]*+ (?:async[ \t]++)?+ def [ \t]++ \w++ [ \t]*+ (?&par) [^:\n]*+ : )
    (?P<body> (?: [ \t]*+ (?: \#[^\n]*+ )? \n )*+ [ \t]*+ (?P<doc> (?: [rRuU]?\"\"\"(?:\\.|(?!\"\"\").)*+\"\"\" | [rRuU]?'''(?:\\.|(?!''').)*+''' | [rRuU]?"(?:\\.|[^"\\\n])++"(?=[ \t]*+(?:\n|\Z)) | [rRuU]?'(?:\\.|[^'\\\n])++'(?=[ \t]*+(?:\n|\Z)) ) )?+ (?: . )*+ )
    """,
    regex.X | regex.S,
)
_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_LEAD_ONLY = re.compile(r"\s*(?:(?://[^\n]*|/\*.*?\*/)\s*)*", re.S)


def _blocks(lead: str) -> list[tuple[str, bool, str]]:
    """(marker, blank line behind, raw text) of the comments before a function; lines of one marker are one block."""
    out: list[list] = []
    for m in _COMMENT.finditer(lead):
        raw = m[0]
        mark = next(x for x in ("///", "//!", "/**", "/*!", "//", "/*") if raw.startswith(x))
        if raw.startswith("/**/"):
            mark = "/*"
        nxt = _COMMENT.search(lead, m.end())
        blank = lead[m.end() : nxt.start() if nxt else len(lead)].count("\n") > 1
        if out and out[-1][0] == mark and mark[1] == "/" and not out[-1][1]:
            out[-1][1], out[-1][2] = blank, out[-1][2] + "\n" + raw
        else:
            out.append([mark, blank, raw])
    return [tuple(x) for x in out]


def _own_comment(fam: str, lead: str, sig: str) -> str | None:
    """The comment that the language takes as documentation of the function that follows."""
    found = _blocks(lead)
    if fam == "go":
        own = []
        for _, blank, raw in reversed(found):
            if blank:
                break
            own.append(raw)
        lines = [x for x in "\n".join(reversed(own)).split("\n") if not re.match(r"\s*//(?:go|line|export|nolint)\b:?", x)]
        return "\n".join(lines) or None
    marks = ("///", "//!", "/**", "/*!") if fam == "cpp" else ("/**",)
    docs = [raw for mark, _, raw in found + _blocks(sig.split("(", 1)[0]) if mark in marks]
    return docs[-1] if docs else None


def capture(code: str, fam: str) -> tuple[str | None, str, str] | None:
    """(documentation comment, signature, code without it) of a function's source; None if it is no function.

    Source whose brackets do not match (cut off) keeps all of its code; its signature ends at the first brace.
    """
    code = code.replace("\r\n", "\n").replace("\r", "\n")
    if fam == "python":
        m = _PYTHON.match(code)
        if not m:
            return None
        doc = m["doc"]
        body = m["body"] if doc is None else m["body"].replace(doc, "", 1)
        return (doc and re.sub(r"^[rRuU]?(?:\"\"\"|'''|[\"'])|(?:\"\"\"|'''|[\"'])$", "", doc), m["sig"].strip(), m["sig"] + body)
    m = _C_LIKE[fam].match(code)
    if m:
        lead, sig, body = m["lead"], m["sig"], m["body"]
    else:
        lead = _LEAD_ONLY.match(code)[0]
        rest = code[len(lead) :]
        sig = rest.partition("{")[0]
        body = rest[len(sig) :]
    doc = _own_comment(fam, lead, sig)
    return doc and clean_comment(doc), _COMMENT.sub("", sig).strip(), (sig + body).strip()


#: Notices that describe no function.
_LEGAL = re.compile(
    r"copyright|©|\(c\)\s+(?:the|by|\d)|all rights reserved|licen[sc]ed|spdx|under the terms|without warrant|版权|保留所有权利|许可证|授权使用|alle rechte vorbehalten|urheberrecht|lizenz|tous droits|sous licence|derechos reservados|bajo (?:la )?licencia|все права|лиценз|著作権|無断|ライセンス",
    re.I,
)
_FILE = re.compile(
    r"\bthis (?:file|module|header|source)\b|do not (?:edit|change|modify)|\bgenerated (?:by|from)\b|auto-?generated|@generated|from the interface description|\b(?:diese|die) datei\b|\bce fichier\b|\beste archivo\b|(?:этот|данный) файл|このファイル|本文件|此文件|该文件由|自动生成|自動生成|请勿(?:手工|手动|编辑)",
    re.I,
)
_NOTE = re.compile(r"\b(?:TODO|FIXME|XXX|HACK|TBD|WIP)\b.*$|@todo.*$|待补充.*$", re.S)
_EMPTY = re.compile(
    r"^\W*(?:n/?a|none|stub|undocumented|description|no (?:description|documentation|comment|docs?)(?: (?:yet|available|provided|given|here))*|not (?:yet )?documented(?: yet)?|to be (?:documented|written|done|added|completed|filled in)(?: later)?|documentation (?:missing|pending|to follow|goes here)|description (?:missing|pending|to follow|goes here)|add (?:a )?(?:description|documentation) here|insert (?:a )?description here|see (?:the )?(?:header|above|below|base class|declaration|implementation|parent|interface)(?: file| for details)?|constructor|destructor|default constructor|getter|setter|placeholder|same as above|\{@inheritdoc\}|inherit ?doc|beschreibung (?:fehlt|folgt)(?: noch)?|(?:noch )?keine beschreibung(?: vorhanden)?|siehe (?:header|oben)|à (?:compléter|documenter|faire)|(?:pas|aucune) (?:de )?description|voir (?:plus haut|ci-dessus)|sin (?:descripción|documentar|documentación)|por (?:documentar|hacer|completar)|pendiente(?: de documentar)?|нет описания|описание (?:отсутствует|будет позже)|без описания|待补充|待完善|暂无(?:说明|描述|注释)?|无(?:说明|描述)|説明なし|未記入|後で書く|未実装)\W*$",
    re.I,
)
#: Words that carry nothing of their own.
_WEAK = {"the", "a", "an", "of", "this", "that", "its", "it", "is", "function", "method", "class", "constructor", "destructor", "for", "to", "and", "in", "on", "from", "with", "by", "or", "der", "die", "das", "le", "la", "les", "el", "los", "de", "des", "du"}


def description(doc: str | None, name: str | None, signature: str | None = None, owner: str | None = None) -> str | None:
    """The describing sentences of a documentation comment; None if it describes nothing.

    Placeholders, bare tags, legal and file notices, rulers, commented-out code
    and the function's own name in words are no description; a note to do is
    taken off what stands before it.
    """
    if not doc:
        return None
    own = name_words(name) | name_words(owner)
    kept = []
    for tag, s in units(doc):
        if tag in ("todo", "author", "file", "copyright", "license", "version", "since", "see", "date"):
            continue
        s = _NOTE.sub("", s).strip()
        if not s or _EMPTY.match(s) or _LEGAL.search(s) or _FILE.search(s) or is_code(s):
            continue
        text = running_text(s)
        if not text:
            continue
        words = {w.lower() for w in re.findall(r"[^\W_]+", text)}
        if re.search(r"[㐀-鿿ぁ-ヿ]", text) or len({w for w in words if w not in _WEAK and w not in own and w.rstrip("s") not in own and not w.isdigit()}) >= 2:
            kept.append(s)
    return " ".join(kept) or None


def _rows(batches):
    for b in batches:
        out: list[tuple] = []
        for i, name, code, path, lang, owner in zip(*(c.to_pylist() for c in b.columns)):
            fam = family(lang, path)
            got = capture(code, fam) if code else None
            text = got and description(got[0], name, got[1], owner)
            if text:
                out.append((i, name, fam, got[1], got[0].strip(), text, got[2]))
        cols = list(zip(*out)) if out else [[]] * 7
        types = [pa.int64(), *[pa.string()] * 6]
        names = ["symbol_id", "name", "language", "signature", "comment", "description", "code"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def documented_functions(symbols: DataFrame) -> DataFrame:
    """Code-description pairs of the rows of kind function or method whose own comment describes something.

    Columns: symbol_id, name, language (family), signature, comment, description,
    code (without the comment). The file suffix decides on the language, then the
    column ``language``. NULL or empty definitions give no pair; repeated rows give
    a pair each; a NULL name or path is allowed.
    """
    src = symbols.filter(F.col("kind").isin("function", "method")).select(F.col("id").cast("long"), "name", "definition", "file_path", "language", "parent_class")
    return src.mapInArrow(_rows, "symbol_id long, name string, language string, signature string, comment string, description string, code string")
