"""Generated, minified, vendored files and data blobs among source files.

Each file (all rows of ``symbols`` with its repo and path) becomes two sets
of five-token shingles, one with identifiers and literals masked, one as it
stands. The masked sets are clustered by MinHash banding with verification;
what a cluster spans says what it is: copies under several repositories are
vendored (checked on the unmasked tokens), families of one repository that
differ only in their names are generated, clusters of nothing but literals are
data, clusters of terse names without layout are minified, and a cluster most of
whose members are marked as generated is generated. Places that declare foreign
or generated code are taken at their word, and so are notices: first comment
lines that hold the masked shingles of a labelled one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgrove.llm.similar import similar_classes
from symgrove.operators.skew import hot_join, hot_keys
from symgrove.session import cut, cut_counted

SHINGLE = 5
#: Evidence needs this much: tokens of a copy, tokens and files of a family, characters of literals of a blob.
COPY_TOKENS = 30
FAMILY_TOKENS, FAMILY_FILES = 120, 4
BLOB_CHARS, BLOB_SHARE = 500, 0.5
MINIFIED_CHARS, MINIFIED_NAMES = 300, 20
SALTS = 16

#: Directories that declare foreign code, names and directories that declare generated code.
VENDOR_PLACE = r"(?i)(^|/)(vendor|vendored|_vendor|third[_-]?party|3rd[_-]?party|node_modules|bower_components|jspm_packages|external|externals|extern|deps|godeps|_deps|pods|carthage|site-packages|dist-packages|subprojects|contrib/(imported|vendor|third_party))/"
GENERATED_NAME = r"(?i)(^|/)(moc_[^/]+\.(cpp|cc|cxx|h)|qrc_[^/]+\.(cpp|cc|cxx)|ui_[^/]+\.h|lex\.[^/]+\.(c|cc|cpp)|zz_generated[^/]*|[^/]+(_pb2|_pb2_grpc)\.pyi?|[^/]+\.pb\.(cc|h|go|cpp)|[^/]+(\.|_)(pb|grpc|twirp)\.go|[^/]+\.(tab|yy)\.(c|h|cc|cpp|hpp)|[^/]+[._]g(en|enerated)\.[a-z]+|[^/]+\.(designer|g|g\.i)\.[a-z]+|[^/]+\.freezed\.dart|[^/]+_(gen|generated)\.[a-z]+)$"
GENERATED_PLACE = r"(?i)(^|/)(gen|generated|__generated__|autogen|auto-generated|auto_generated|generated-sources|generated_src|build/gen)/"
#: Labelled notices of generators; NAME and what is not a word of these lines is masked.
NOTICES = """@generated
@generated NAME
@generated by NAME
@generated from NAME
AUTOGENERATED
AUTOGENERATED NAME
auto-generated by NAME
Code generated by NAME. DO NOT EDIT.
Generated by NAME. DO NOT EDIT.
Generated code. Do not edit.
Generated by the NAME compiler. DO NOT EDIT!
Automatically generated by NAME. Do not edit.
Automatically generated file. Do not edit.
Automatically generated from NAME. Do not modify.
This file was automatically generated by NAME. Do not edit.
This file is automatically generated. Do not edit.
This file was automatically generated from NAME; changes will be lost.
This file was automatically produced from NAME; changes will be lost.
This file is generated by NAME, do not edit it by hand.
This code was generated by a tool. Changes to this file will be lost if the code is generated again.
Created by the NAME compiler from the interface description, edit that one instead.
Machine generated, do not edit.
Machine-generated file, do not modify.
Do not edit this file, it is generated.
DO NOT EDIT. This file was generated.
DO NOT MODIFY. Generated by NAME.
Diese Datei wurde maschinell erzeugt und darf nicht von Hand geändert werden.
Diese Datei wurde maschinell erzeugt und darf nicht geändert werden.
Diese Datei wurde maschinell erzeugt. Änderungen gehen verloren.
Diese Datei wurde automatisch erzeugt. Nicht bearbeiten.
Diese Datei wurde automatisch generiert, bitte nicht ändern.
Automatisch erzeugte Datei, nicht von Hand ändern.
Ce fichier a été généré automatiquement, ne pas le modifier.
Ce fichier est généré par NAME, ne pas modifier à la main.
Fichier généré automatiquement par NAME. Ne pas modifier.
Este archivo fue generado automáticamente, no lo edite.
Este archivo ha sido generado por NAME, no modificar a mano.
Archivo generado automáticamente por NAME. No editar.
Этот файл создан автоматически, не изменяйте его вручную.
Этот файл сгенерирован автоматически. Не редактировать.
Файл сгенерирован программой NAME, не править вручную.
自动生成的文件，请勿手工修改
此文件由 NAME 自动生成，请勿编辑
本文件自动生成，请勿修改
自動生成されたファイルです。編集しないでください。
このファイルは NAME によって自動生成されました。手で変更しないでください。"""
#: Share of a notice's shingles that the first line of a comment must hold to be one.
NOTICE_SHARE = 0.8
_LEAD = re.compile(r"\s*(?://|#|/\*|\"\"\"|''')[!/*]*\s*(.*)")
_STRINGS = r'[rRbBuUfF]?""".*?"""|[rRbBuUfF]?\'\'\'.*?\'\'\'|R"\(.*?\)"|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`'
#: Most tokens are a word that no dot or quote follows, or a sign that begins nothing longer; they are tried first, and blanks end there.
_FAST = r"""\w++(?![."'])|[^\w\s"'`/\#]|(?=\S)"""
_TOKEN = re.compile(rf"{_FAST}(?://[^\n]*|/\*.*?\*/|{_STRINGS}|\w[\w.]*(?<=\d)\b|\w+|[^\w\s])", re.S)
_TOKEN_PY = re.compile(rf"{_FAST}(?:\#[^\n]*|{_STRINGS}|\w[\w.]*(?<=\d)\b|\w+|[^\w\s])", re.S)
#: Words of the languages that stay unmasked.
KEYWORDS = frozenset(
    "if else for while do switch case return break continue function var let const class struct enum union public private protected static final void int float double char bool boolean long short unsigned signed def self None True False null true false nullptr new delete this template typename namespace using import export from package func type interface extends implements override virtual inline auto try catch throw throws finally lambda yield with as in not and or is pass raise go defer range chan map async await".split()
)
#: Masked tokens: string, number, identifier.
STRING, NUMBER, IDENT = 1, 2, 3


class Vocabulary(dict):
    """Numbers of the tokens met in this process, with what is known of each; emptied when it is full."""

    FULL = 400_000
    FIELDS = ("masked", "plain", "lit", "lit_chars", "ident", "ident_chars", "comma")

    def __init__(self):
        self.rows = [(0,) * len(self.FIELDS)]  # 0 stands for comments
        self.table = np.zeros((len(self.FIELDS), 0), dtype=np.int64)

    def __missing__(self, t: str) -> int:
        c = t[0]
        if t.startswith(("//", "/*")) or (c == "#" and len(t) > 1):
            self[t] = 0
            return 0
        plain = zlib.crc32(t.encode()) + 4
        if c in "\"'`" or (len(t) > 2 and t[-1] in "\"'"):
            row = (STRING, plain, 1, len(t) if len(t) >= 40 and " " not in t else 0, 0, 0, 0)
        elif c.isdigit():
            row = (NUMBER, plain, 1, len(t), 0, 0, 0)
        elif (c.isalpha() or c == "_") and t not in KEYWORDS:
            row = (IDENT, plain, 0, 0, 1, len(t), 0)
        else:
            row = (plain, plain, 0, 0, 0, 0, int(t == ","))
        self[t] = n = self.table.shape[1] + len(self.rows)
        self.rows.append(row)
        return n

    def known(self, numbers: np.ndarray) -> dict[str, np.ndarray]:
        """What is known of each token, by field."""
        if self.rows:
            self.table = np.concatenate([self.table, np.array(self.rows, dtype=np.int64).T], axis=1)
            self.rows = []
        return {c: row[numbers] for c, row in zip(self.FIELDS, self.table)}


_vocabulary = Vocabulary()


_POW = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def shingles(tokens: np.ndarray, text: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    """Distinct int32 hashes, sorted, of the runs of five tokens within one text each, for each of ``n`` files; ``text`` numbers the tokens' texts, ``owner`` has the file of each text."""
    m = max(0, len(tokens) - SHINGLE + 1)
    h = np.zeros(m, dtype=np.uint64)
    for j in range(SHINGLE):
        h += tokens[j : j + m] * _POW[j]
    whole = text[:m] == text[len(text) - m :]
    h, file = h[whole], owner[text[:m][whole]]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    # file above hash, the sign bit turned over so that hashes are sorted as int32
    key = distinct((file.astype(np.uint64) << np.uint64(32)) | ((h >> np.uint64(32)) ^ np.uint64(2**31)))
    ends = np.searchsorted(key, np.arange(1, n, dtype=np.uint64) << np.uint64(32))
    return np.split((key.astype(np.uint32) ^ np.uint32(2**31)).view(np.int32), ends)


_HEAD_TOKEN = re.compile(r"[a-z]*\d[0-9a-z]*|@?[^\W\d_ぁ-ヿ㐀-鿿]+|[ぁ-ヿ㐀-鿿]")
_HEAD_WORDS = frozenset(w.lower() for w in _HEAD_TOKEN.findall(NOTICES)) - {"name", "tool", "compiler", "программой"}  # what may name a tool


def head_shingles(line: str) -> frozenset[tuple[str, ...]]:
    """Five-token shingles of a comment line, its names and numbers masked; a shorter line is one shingle."""
    t: list[str] = []
    for w in _HEAD_TOKEN.findall(line.lower()):
        w = w if w in _HEAD_WORDS else "_"
        if w != "_" or t[-1:] != ["_"]:
            t.append(w)
    return frozenset(tuple(t[i : i + SHINGLE]) for i in range(max(1, len(t) - SHINGLE + 1))) if t else frozenset()


_NOTICE_SETS = [head_shingles(x) for x in NOTICES.split("\n")]
_NOTICE_INDEX: dict[tuple[str, ...], list[int]] = {}
for _i, _set in enumerate(_NOTICE_SETS):
    for _s in _set:
        _NOTICE_INDEX.setdefault(_s, []).append(_i)


#: Every line that holds NOTICE_SHARE of a notice has one of these in it, so others need no look-up.
_NOTICE_CUE = re.compile(r"generat|produced|created|erzeugt|generiert|généré|generado|сгенер|создан|生成", re.I)


@lru_cache(100_000)
def is_notice(line: str) -> bool:
    """Whether a comment line holds NOTICE_SHARE of the shingles of a labelled notice."""
    if not _NOTICE_CUE.search(line):
        return False
    hits = Counter(i for x in head_shingles(line) for i in _NOTICE_INDEX.get(x, ()))
    return any(n >= NOTICE_SHARE * len(_NOTICE_SETS[i]) for i, n in hits.items())


_SUMS = ("n_rows", "tokens", "lit", "lit_chars", "ident", "ident_chars", "chars", "spaces", "lines", "notices")
_FILE = "repo string, file_path string, " + ", ".join(f"{c} long" for c in _SUMS) + ", masked array<int>, plain array<int>, text_id binary"


class _File:
    """Running state of one file: sums, and the whole sets of the shingles folded so far."""

    def __init__(self, key):
        self.key, self.n = key, dict.fromkeys(_SUMS, 0)
        self.split = (_TOKEN_PY if key[1].endswith((".py", ".pyi")) else _TOKEN).findall
        self.kept = 0
        self.sets = [np.zeros(0, dtype=np.int32)] * 2


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets), pa.int32()))


def _text_id(plain: np.ndarray) -> bytes:
    """128 bits that stand for a text, so that texts are counted exactly at any number of files."""
    return hashlib.blake2b(plain.tobytes(), digest_size=16).digest()


class _Files:
    """Files of a task that are not handed on yet, and their tokens not yet folded (bounded); the texts of all these files are folded at once."""

    KEPT, FILES = 100_000, 2_000

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.files: list[_File] = []
        self.tokens: list[int] = []
        self.ends: list[int] = []
        self.owner: list[int] = []

    def full(self) -> bool:
        return len(self.tokens) > self.KEPT or len(self.files) >= self.FILES or len(_vocabulary) > Vocabulary.FULL

    def add(self, code: str) -> None:
        """A text of the last file."""
        file = self.files[-1]
        n, lines = file.n, code.count("\n") + 1
        first = _LEAD.match(code)
        n["n_rows"] += 1
        n["chars"] += len(code)
        n["lines"] += lines
        n["spaces"] += code.count(" ") + code.count("\t") + lines - 1
        n["notices"] += bool(first and is_notice(first[1]))
        tokens = file.split(code)
        self.tokens += map(_vocabulary.__getitem__, tokens)
        self.ends.append(len(self.tokens))
        self.owner.append(len(self.files) - 1)
        file.kept += len(tokens)
        if file.kept > self.KEPT:
            self.fold()

    def fold(self) -> None:
        """Work off the texts kept so far."""
        if self.ends:
            k = len(self.files)
            t, owner = np.array(self.tokens, dtype=np.int64), np.array(self.owner, dtype=np.int64)
            text = np.repeat(np.arange(len(self.ends)), np.diff([0, *self.ends]))
            t, text = t[t > 0], text[t > 0]
            known, file = _vocabulary.known(t), owner[text]
            sums = {"tokens": np.bincount(file, minlength=k)} | {c: np.bincount(file, known[c], k).astype(np.int64) for c in ("lit", "lit_chars", "ident", "ident_chars")}
            sums["lit_chars"] += np.minimum(np.bincount(file, known["comma"], k).astype(np.int64), sums["lit"])
            for c, x in sums.items():
                for f, v in zip(self.files, x.tolist()):
                    f.n[c] += v
            # texts of fewer tokens than a shingle are filled up, so that they count as one
            size = np.bincount(text, minlength=len(self.ends))
            short = np.flatnonzero((size > 0) & (size < SHINGLE))
            fill = np.repeat(short, SHINGLE - size[short])
            order = np.argsort(np.concatenate([text, fill]), kind="stable")
            text = np.concatenate([text, fill])[order]
            for i, c in enumerate(("masked", "plain")):
                tokens = np.concatenate([known[c], np.zeros(len(fill), dtype=np.int64)])[order].astype(np.uint64)
                for f, now in zip(self.files, shingles(tokens, text, owner, k)):
                    f.sets[i] = distinct(np.concatenate([f.sets[i], now])) if len(f.sets[i]) else now
        self.tokens, self.ends, self.owner = [], [], []
        for f in self.files:
            f.kept = 0

    def rows(self) -> pa.RecordBatch:
        """All files, which are complete; none are kept."""
        global _vocabulary
        self.fold()
        keys = [pa.array([f.key[i] for f in self.files], pa.string()) for i in range(2)]
        sums = [pa.array([f.n[c] for f in self.files], pa.int64()) for c in _SUMS]
        sets = [[f.sets[i] for f in self.files] for i in range(2)]
        names = [c.split()[0] for c in _FILE.split(", ")]
        out = pa.RecordBatch.from_arrays([*keys, *sums, *map(_lists, sets), pa.array(map(_text_id, sets[1]), pa.binary())], names=names)
        if len(_vocabulary) > Vocabulary.FULL:
            _vocabulary = Vocabulary()
        self.clear()
        return out


def _scan_files(batches):
    now = _Files()
    for b in batches:
        for repo, path, code in zip(*(b.column(i).to_pylist() for i in range(3))):
            if not now.files or now.files[-1].key != (repo, path):
                if now.full():
                    yield now.rows()
                now.files.append(_File((repo, path)))
            now.add(code or "")
    if now.files:
        yield now.rows()


def _with_text_id(batches):
    for b in batches:
        plain = b.column(b.num_columns - 1)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_text_id(np.array(x.values, dtype=np.int32)) for x in plain], pa.binary())], names=[*b.schema.names, "text_id"])


def scan_files(symbols: DataFrame) -> DataFrame:
    """Measures and shingle sets, one row per (repo, file_path).

    The text is shuffled once, by file; files that hold much of all rows are
    salted over several tasks and their partial rows merged.
    """
    src = symbols.select(F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("file_path", F.lit("")).alias("file_path"), "id", "definition")
    hot = hot_keys(src, ["repo", "file_path"], 0.005)
    salt = F.lit(0)
    if hot:
        big = F.concat_ws("\0", "repo", "file_path").isin(["\0".join(x) for x in hot])
        salt = F.when(big, F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0)
    src = src.withColumn("salt", salt).repartition("repo", "file_path", "salt").sortWithinPartitions("repo", "file_path")
    files = src.select("repo", "file_path", "definition").mapInArrow(_scan_files, _FILE)
    if not hot:
        return files
    files = cut(files, "files")
    union = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("masked", "plain")]  # SALTS lists
    big = F.concat_ws("\0", "repo", "file_path").isin(["\0".join(x) for x in hot])
    merged = files.filter(big).groupBy("repo", "file_path").agg(*[F.sum(c).alias(c) for c in _SUMS], *union).mapInArrow(_with_text_id, _FILE)
    return files.filter(~big).unionByName(merged)


def _minified() -> Column:
    """Layout of minified code, over the sums of a cluster: wide lines, terse names, hardly a space."""
    wide = F.col("c_chars") / F.col("c_lines") > 160
    terse = (F.col("c_ident_chars") / F.greatest(F.col("c_ident"), F.lit(1)) < 3.2) & (F.col("c_spaces") / F.col("c_chars") < 0.12)
    return (F.col("chars") >= MINIFIED_CHARS) & (F.col("ident") >= MINIFIED_NAMES) & wide & terse


def file_origins(symbols: DataFrame) -> DataFrame:
    """What each file is: repo, file_path, class_id, class_files, class_repos, declared, notice, minified, data, copied, family, origin.

    Every file belongs to a cluster of files with similar masked shingles (one
    that resembles none is a cluster of its own), and ``minified``, ``data`` and
    ``family`` are read off the sums over the cluster, ``copied`` off clusters of the unmasked shingles.
    ``declared`` and ``notice`` are what a file's place, name or first comment says.
    ``origin`` is the first that applies of vendored (copied, or declared), minified, data,
    generated (family, notice or declared; or so are most of its cluster), or ``hand-written``. Generators' own text, lists and tables written by hand
    (under 500 characters of literals) are hand-written. NULL definitions count as
    empty, a NULL repo or path as ''; repeated rows change nothing but counts.
    """
    key = F.concat_ws("\0", "repo", "file_path")
    files, n = cut_counted(scan_files(symbols).withColumn("id", key), "files", rows=F.count(F.lit(1)))
    n_files = n["rows"]
    cls = similar_classes(files.select("id", F.lit("").alias("block"), F.col("masked").alias("sketch")), total=n_files).withColumnRenamed("cls", "class_id")
    vendor, gen = F.col("file_path").rlike(VENDOR_PLACE), F.col("file_path").rlike(GENERATED_NAME) | F.col("file_path").rlike(GENERATED_PLACE)
    f = files.withColumns({"vendor_place": vendor, "gen_place": gen, "notice": F.col("notices") > 0})
    f = cut(f.drop("masked", "plain").join(cls, "id"), "classed")
    # what a cluster spans and holds; per text and repo first, so that a large cluster is counted in parts
    sums = ("chars", "lines", "spaces", "lit_chars", "ident", "ident_chars")
    per_text = f.groupBy("class_id", "repo", "text_id").agg(F.count(F.lit(1)).alias("n"), F.min("tokens").alias("least"), F.count_if(F.col("notice") | F.col("gen_place")).alias("n_gen"), *[F.sum(c).alias(c) for c in sums])
    per_repo = per_text.groupBy("class_id", "repo").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.min("least").alias("least"), F.sum("n_gen").alias("n_gen"), *[F.sum(c).alias(c) for c in sums])
    per_repo, n = cut_counted(per_repo, "per-repo", rows=F.count(F.lit(1)))
    span = per_repo.groupBy("class_id").agg(F.sum("n").alias("class_files"), F.count(F.lit(1)).alias("class_repos"), F.sum("n_gen").alias("gen_files"), *[F.sum(c).alias(f"c_{c}") for c in sums])
    family = (F.col("texts") >= FAMILY_FILES) & (F.col("least") >= FAMILY_TOKENS)
    known = hot_join(per_repo.select("class_id", "repo", family.alias("family")), span, ["class_id"], total=n["rows"])
    f = cut(hot_join(f, known, ["class_id", "repo"], total=n_files), "clusters")  # a class may hold much of all files
    # an exact check follows: the same tokens, unmasked, under several repositories
    suspects = f.filter((F.col("class_repos") > 1) & (F.col("tokens") >= COPY_TOKENS)).select("id", "class_id")
    suspects, n = cut_counted(files.select("id", "plain").join(suspects, "id"), "suspects", rows=F.count(F.lit(1)))
    copies = similar_classes(suspects.select("id", F.col("class_id").alias("block"), F.col("plain").alias("sketch")), total=n["rows"]).withColumnRenamed("cls", "copy_id")
    copies = cut(copies.withColumn("copy_repo", F.substring_index("id", "\0", 1)), "copies")
    foreign = copies.groupBy("copy_id", "copy_repo").agg(F.lit(1).alias("one")).groupBy("copy_id").agg(F.count("one").alias("r")).filter("r > 1").select("copy_id", F.lit(True).alias("copied"))
    copied = hot_join(copies, foreign, ["copy_id"], total=n["rows"]).filter("copied").select("id", "copied")
    out = f.join(copied, "id", "left")
    # literals fill the cluster, and there are enough of them in the file
    blob = (F.col("lit_chars") >= BLOB_CHARS) & (F.col("c_lit_chars") >= BLOB_SHARE * F.col("c_chars"))
    out = out.withColumns({"minified": _minified(), "data": blob, "copied": F.coalesce("copied", F.lit(False)), "family": F.col("family") & ~blob})
    made = F.col("gen_place") | F.col("notice") | F.col("family") | (F.col("gen_files") * 2 > F.col("class_files"))
    origin = F.when(F.col("vendor_place") | F.col("copied"), "vendored").when(F.col("minified"), "minified").when(F.col("data"), "data").when(made, "generated").otherwise("hand-written")
    return out.select("repo", "file_path", "class_id", "class_files", "class_repos", (F.col("vendor_place") | F.col("gen_place")).alias("declared"), "notice", "minified", "data", "copied", "family", origin.alias("origin"))
