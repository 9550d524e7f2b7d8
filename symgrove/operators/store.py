"""Write semantics of the stored tables, as pure functions of frames, and their storage."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from symgrove.schemas import KEYS, REPO, SCHEMAS, empty


def first_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; partial aggregation, so no key is gathered. NULL is a key like any other."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_r")).select(*[f"_r.{c}" if c in rest else c for c in df.columns])


def last_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*[f"_r.{c}" if c in rest else c for c in df.columns])


def upsert_symbols(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Symbols after an upsert: of each key the earliest row stays (id too), the lines come from the latest."""
    all_ = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    keys, lines = KEYS["symbols"], ["line_start", "line_end"]
    rank = F.struct("_new", *order)
    rest = [c for c in old.columns if c not in keys and c not in lines]
    g = all_.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_r"), F.max_by(F.struct(*lines), rank).alias("_l"))
    return g.select(*[f"_l.{c}" if c in lines else f"_r.{c}" if c in rest else c for c in old.columns])


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``old`` and the first row of each key of ``new`` that ``old`` does not have."""
    fresh = first_row(new, keys, order)
    cond = F.lit(True)
    o = old.select(*[F.col(k).alias(f"_o_{k}") for k in keys])
    for k in keys:
        cond = cond & fresh[k].eqNullSafe(o[f"_o_{k}"])
    return old.unionByName(fresh.join(o, cond, "left_anti"))


def replace_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key."""
    return last_row(df, keys, order)


def add_branch(branches: DataFrame, symbols: DataFrame, repo: str, branch: str) -> DataFrame:
    """Memberships after a full scan: every symbol of the repo belongs to the branch."""
    add = symbols.filter(F.col("repo") == repo).select(F.col("id").alias("symbol_id"), "repo", F.lit(branch).alias("branch_name"), F.lit(None).cast("string").alias("override_def"), F.lit(None).cast("string").alias("override_hash"))
    return branches.select(add.columns).unionByName(add).distinct()


def delete_branch(df: DataFrame, branch: str, repo: str) -> DataFrame:
    """Rows that stay when a branch of a repo is removed; rows without a repo go too."""
    gone = (F.col("branch_name") == branch) & ((F.col("repo") == repo) | F.col("repo").isNull() | (F.col("repo") == ""))
    return df.filter(~F.coalesce(gone, F.lit(False)))


def replace_files(old: DataFrame, new: DataFrame, keys: tuple[str, str] = ("repo", "file_path")) -> DataFrame:
    """``old`` without the rows of the files that ``new`` has, and ``new``."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(old.columns).unionByName(new.select(old.columns))


class Store:
    """Tables under a root folder, repository by repository.

    A table is a set of parts, folders of parquet files that are never written
    again; each holds the rows of one repository (those without one are of ''), or,
    after :meth:`write`, of all. The file CURRENT names the parts and is replaced
    in one step, so a reader sees one state or the next. Replacing a repository
    touches its own part only, and reading one opens no other. Parts that are no
    longer named stay for KEPT more replacements, for readers that have them open.
    """

    ALL = "*"
    KEPT = 5

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _state(self, name: str) -> dict:
        """``parts`` (repository: folder and largest id) and ``old`` (lists of folders that are no longer named, newest first)."""
        fs, p = self._fs(f"{self.root}/{name}/CURRENT")
        if not fs.exists(p):
            return {"parts": {}, "old": []}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/{name}/CURRENT", wholetext=True).collect()))

    def _put(self, name: str, state: dict, gone: list[str]) -> None:
        old = [gone, *state["old"]]
        for folder in (x for late in old[self.KEPT :] for x in late):
            fs, p = self._fs(f"{self.root}/{name}/{folder}")
            fs.delete(p, True)
        text = json.dumps({"parts": state["parts"], "old": old[: self.KEPT]})
        fs, tmp = self._fs(f"{self.root}/{name}/.next-{uuid.uuid4().hex}")
        stream = fs.create(tmp, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs
        how = sc._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(tmp, self._fs(f"{self.root}/{name}/CURRENT")[1], how)

    def _save(self, name: str, df: DataFrame) -> tuple[dict, int]:
        cols = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        folder, seen = uuid.uuid4().hex, Observation()
        top = F.max("id") if "id" in cols else F.lit(0)
        df.select(cols).observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(top, F.lit(0)).alias("top")).write.parquet(f"{self.root}/{name}/{folder}")
        got = seen.get
        return {"folder": folder, "top": got["top"]}, got["rows"]

    def _load(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return empty(self.spark, name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/{name}/{x}" for x in folders])

    def read(self, name: str, repo: str | None = None) -> DataFrame:
        """The table, or its rows of one repository; an empty frame if there is none."""
        parts = self._state(name)["parts"]
        if repo is None:
            return self._load(name, [x["folder"] for x in parts.values()])
        own = self._load(name, [parts[repo]["folder"]]) if repo in parts else empty(self.spark, name)
        if self.ALL in parts:
            own = own.unionByName(self._load(name, [parts[self.ALL]["folder"]]).filter(self._of(name) == repo))
        return own

    @staticmethod
    def _of(name: str):
        return F.coalesce(F.col(REPO.get(name, "repo")), F.lit(""))

    def top_id(self, name: str, without: str | None = None) -> int:
        """Largest id of the table, leaving out the part of one repository."""
        return max((x["top"] for repo, x in self._state(name)["parts"].items() if repo != without), default=0)

    def write(self, name: str, df: DataFrame) -> int:
        """Replace the whole table; the number of rows."""
        part, n = self._save(name, df)
        state = self._state(name)
        gone = [x["folder"] for x in state["parts"].values()]
        self._put(name, {"parts": {self.ALL: part}, "old": state["old"]}, gone)
        return n

    def replace(self, name: str, repo: str, df: DataFrame) -> int:
        """Replace the rows of one repository; ``df`` holds no others. The number of rows."""
        part, n = self._save(name, df)
        state = self._state(name)
        parts = dict(state["parts"])
        gone = [parts[repo]["folder"]] if repo in parts else []
        if self.ALL in parts:
            rest, n_rest = self._save(name, self._load(name, [parts[self.ALL]["folder"]]).filter(self._of(name) != repo))
            gone.append(parts[self.ALL]["folder"])
            parts[self.ALL] = rest
        parts[repo] = part
        self._put(name, {"parts": parts, "old": state["old"]}, gone)
        return n

    def drop(self, name: str | None = None) -> None:
        """Remove one table, or all."""
        fs, p = self._fs(f"{self.root}/{name}" if name else self.root)
        fs.delete(p, True)

    def copy_to(self, root: str) -> Store:
        """The same tables under another root (push and pull), part by part."""
        other = Store(self.spark, root)
        for name in SCHEMAS:
            parts = {repo: other._save(name, self._load(name, [x["folder"]]))[0] for repo, x in self._state(name)["parts"].items()}
            if parts:
                before = other._state(name)
                other._put(name, {"parts": parts, "old": before["old"]}, [x["folder"] for x in before["parts"].values()])
        return other
