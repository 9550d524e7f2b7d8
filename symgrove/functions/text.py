"""Column functions of the text side: tokens, similarity, labels, paths, LIKE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no tokens.
STOP_WORDS = (
    "the and for this that with from have are was not but all can has had been will each its "
    "int void const auto bool char double float long short unsigned signed static inline virtual override "
    "public private protected class struct enum return"
).split()

#: Suffixes of each language, case-sensitive.
LANGUAGES = {**dict.fromkeys(["cpp", "cc", "cxx", "hpp", "hxx", "c", "h"], "cpp"), "py": "python", "java": "java", **dict.fromkeys(["ts", "tsx", "js", "jsx"], "typescript"), "go": "go"}


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of at least two bytes, split at all that is no letter or number; NULL gives none."""
    parts = F.array_distinct(F.split(F.coalesce(text, F.lit("")), r"[^\p{IsAlphabetic}\p{N}]+"))
    return F.filter(F.array_distinct(F.transform(parts, F.lower)), lambda t: (F.octet_length(t) >= 2) & ~t.isin(STOP_WORDS))


def let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays of distinct tokens; 0 if both are empty."""

    def of(x: Column, y: Column) -> Column:
        whole = F.size(x) + F.size(y)
        return F.when(whole == 0, F.lit(0.0)).otherwise(let(F.size(F.array_intersect(x, y)), lambda i: i / (whole - i)))

    return let(a, lambda x: let(b, lambda y: of(x, y)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine cut to 0..1, over the shorter length; 0 for NULL, empty and zero vectors."""
    n = F.least(F.size(a), F.size(b))
    x, y = (F.transform(F.slice(v, 1, n), lambda e: e.cast("double")) for v in (a, b))
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    nx, ny = (F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e)) for v in (x, y))
    ok = (n > 0) & (nx >= 1e-10) & (ny >= 1e-10)
    return F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / (nx * ny)))).otherwise(0.0)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def like(col: Column, pattern: str) -> Column:
    """LIKE without escapes that ignores the case of ASCII letters only; ``%`` and ``_`` are wildcards."""
    p = pattern.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\")
    return F.translate(col, _UPPER, _LOWER).like(p)


def contains(col: Column, part: str) -> Column:
    """``LIKE '%part%'``."""
    return like(col, f"%{part}%")


def label_kind(label: Column) -> Column:
    """What stands before the first colon of an edge label."""
    return F.substring_index(label, ":", 1)


def label_target(label: Column) -> Column:
    """What stands behind the first colon; '' without one."""
    return F.regexp_extract(label, r"(?s)^[^:]*:(.*)$", 1)


def symbol_text(name: Column, signature: Column, definition: Column) -> Column:
    """Name, signature and the first 512 characters of the definition."""
    return F.concat(name, F.lit(" "), F.coalesce(signature, F.lit("")), F.lit(" "), F.coalesce(F.substring(definition, 1, 512), F.lit("")))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a name that begins with its only dot is kept."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Last suffix without its dot, '' if there is none."""
    return F.regexp_extract(basename(path), r".\.([^.]*)$", 1)


def language_of(path: Column) -> Column:
    """Language by suffix, NULL for others."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    for lang in sorted(set(LANGUAGES.values())):
        out = F.when(ext.isin([e for e, x in LANGUAGES.items() if x == lang]), lang).otherwise(out)
    return out


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether an ignore pattern matches: ``dir/``, ``*suffix``, ``part*`` or a plain part of the path; case-sensitive."""
    hit = F.lit(False)
    for p in patterns:
        if p.endswith("/"):
            d = p.rstrip("/")
            hit = hit | path.contains(f"/{d}/") | path.startswith(f"{d}/") | path.startswith(f"./{d}/")
        elif p.startswith("*"):
            hit = hit | path.endswith(p[1:])
        elif p.endswith("*"):
            hit = hit | path.contains(p[:-1])
        else:
            hit = hit | path.contains(p)
    return hit


def ignore_patterns(text: str) -> list[str]:
    """Patterns of an ignore file: lines without comments and blanks."""
    return [x for x in map(str.strip, text.splitlines()) if x and not x.startswith("#")]
