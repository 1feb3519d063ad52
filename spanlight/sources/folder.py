"""Folders as document tables: listing, refusals, ignore rules, decoding, parsing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.functions import columns as C
from spanlight.model import BLOCK, SECTION
from spanlight.sources import parsers

#: Names that look like stores of credentials; no rule lets them in.
CREDENTIALS = (".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "*.ppk", "*.kdbx", "*.keystore", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "credentials", "credentials.*", ".netrc", ".npmrc", ".pypirc")
SKIPPED_FOLDERS = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", ".mypy_cache", ".ruff_cache", ".pytest_cache", "dist", "build", ".spanlight")


def glob_regex(pattern: str) -> str:
    """The pattern as a regular expression that Python and Java both read; * crosses slashes."""
    out = ""
    for ch in pattern:
        out += {"*": ".*", "?": "."}.get(ch, re.sub(r"([^\w])", r"\\\1", ch))
    return out


def is_credential(name: Column) -> Column:
    return F.lower(name).rlike("^(?:" + "|".join(map(glob_regex, CREDENTIALS)) + ")$")


@dataclass(frozen=True)
class IgnoreRules:
    """Ordered rules: a later one wins, ! lets in again, a trailing slash is for folders, a leading one means nothing."""

    rules: tuple[tuple[str, bool, bool], ...] = ()

    @classmethod
    def parse(cls, text: str) -> IgnoreRules:
        out = []
        for line in text.splitlines():
            line = line.strip()
            if line and not line.startswith("#"):
                keep = line.startswith("!")
                bare = line[keep:]
                out.append((bare.strip("/"), keep, bare.endswith("/")))
        return cls(tuple(r for r in out if r[0]))

    def matched_by(self, path: str, is_folder: bool = False) -> str | None:
        """The rule that excludes a path, or None."""
        found = None
        parts = path.split("/")
        for pattern, keep, folders in self.rules:
            what = re.compile(glob_regex(pattern) + r"\Z", re.S)
            names = parts if is_folder or not folders else parts[:-1]
            whole = what.match(path) and (is_folder or not folders)
            if whole or any(what.match(n) for n in names):
                found = None if keep else pattern
        return found


def _hidden(spark: SparkSession, root: str) -> list[str]:
    """Paths below root with a name, or a folder's name, that Spark's listing leaves out; SKIPPED_FOLDERS aside."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base, out, todo = fs.makeQualified(path).toString().rstrip("/"), [], [path]
    while todo:
        for status in fs.listStatus(todo.pop()):
            p = status.getPath()
            if status.isDirectory():
                if p.getName() not in SKIPPED_FOLDERS:
                    todo.append(p)
            elif any(n.startswith((".", "_")) for n in p.toString()[len(base) + 1 :].split("/")):
                out.append(p.toString()[len(base) + 1 :])
    return out


def _bytes_of(spark: SparkSession, path: str) -> bytes:
    """A file's bytes by the driver, from any store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def walk(spark: SparkSession, root: str, rules: IgnoreRules = IgnoreRules()) -> tuple[DataFrame, DataFrame]:
    """(files, skipped): (source_path, length, bytes) of what is taken, and (source_path, reason, rule) of what isn't.

    Listed and read by Spark, so the folder may be in any store. Spark's readers pass over names that
    start with a dot or underscore: files in such folders are read by their paths, and files that
    have such a name themselves, a few in any folder, one by one by the driver. Credential stores are
    never read. Files below SKIPPED_FOLDERS aren't reported.
    """
    hidden = _hidden(spark, root)
    here = root.rstrip("/")
    named = [p for p in hidden if p.rsplit("/", 1)[-1].startswith((".", "_"))]
    below = sorted(set(hidden) - set(named))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if below:
        raw = raw.unionByName(spark.read.format("binaryFile").load([f"{here}/{p}" for p in below]))
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/") + "/"
    plain = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    listed = raw.select(F.substr(plain, F.lit(len(full) + 1)).alias("source_path"), "length", F.col("content").alias("bytes"))
    secret = re.compile("|".join(map(glob_regex, CREDENTIALS)))
    own = [(p, None) if secret.fullmatch(p.rsplit("/", 1)[-1].lower()) or rules.matched_by(p) is not None else (p, _bytes_of(spark, f"{here}/{p}")) for p in named]
    if own:
        listed = listed.unionByName(spark.createDataFrame([(p, len(b or b""), b) for p, b in own], "source_path string, length bigint, bytes binary"))
    skipped_folders = "(?:^|/)(?:" + "|".join(map(glob_regex, SKIPPED_FOLDERS)) + ")/"

    @F.pandas_udf("string")
    def ignored(paths: pd.Series) -> pd.Series:
        return paths.map(rules.matched_by)

    name = F.element_at(F.split("source_path", "/"), -1)
    rule = F.when(is_credential(name), name).otherwise(ignored("source_path") if rules.rules else F.lit(None).cast("string"))
    reason = F.when(is_credential(name), "looks like a store of credentials").when(F.col("rule").isNotNull(), "excluded by an ignore rule")
    judged = listed.where(~F.col("source_path").rlike(skipped_folders)).withColumn("rule", rule).withColumn("reason", reason)
    return judged.where("reason is null").select("source_path", "length", "bytes"), judged.where("reason is not null").select("source_path", "reason", "rule")


def read_text(raw: bytes) -> str:
    """UTF-8 text of a file, without byte-order mark; binary and other encodings raise."""
    if b"\0" in raw[:8192]:
        raise ValueError("binary")
    return raw.decode("utf-8-sig")


def parsed(files: DataFrame) -> DataFrame:
    """files(source_path, bytes) as documents, with failure (null if all went well; `no parser` for unknown suffixes)."""
    known = parsers.registry()
    schema = f"source_path string, media_type string, content string, sections array<{SECTION}>, blocks array<{BLOCK}>, metadata map<string,string>, failure string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (b.iloc[at : at + C.ROWS] for b in batches for at in range(0, len(b), C.ROWS)):  # blocks take more room than texts
            rows = []
            for path, raw in zip(pdf["source_path"], pdf["bytes"]):
                name = path.rsplit("/", 1)[-1]
                parser = known.get(name[name.rfind(".") :].lower()) if name.rfind(".") > 0 else None
                if parser is None:
                    rows.append((path, None, None, None, None, None, "no parser"))
                    continue
                try:
                    text = read_text(raw)
                    p = parser.parse(text)
                    sections = [dict(zip(("heading", "level", "start", "end"), s)) for s in p.sections]
                    blocks = [dict(zip(("kind", "start", "end", "level"), b)) for b in p.blocks]
                    rows.append((path, parser.media_type, text, sections, blocks, p.metadata, None))
                except ValueError as e:  # UnicodeDecodeError too
                    rows.append((path, parser.media_type, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["source_path", "media_type", "content", "sections", "blocks", "metadata", "failure"])

    out = files.select("source_path", "bytes").mapInPandas(run, schema)
    return out.withColumns({"document_id": C.document_id(F.col("source_path")), "version": C.content_hash(F.col("content"))})
