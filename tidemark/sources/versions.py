"""Versioned tables: immutable data folders and a log of commits that says which of them make up a version.

A table is cut into parts (months of its date, or one part where it has none). Below the root lie ``data/<id>/part=<part>``
folders, written once, and ``commits/<number>.json``, a manifest of the folders of each part. A commit is a rename that
fails if its number is taken, so a reader sees a version whole or not at all, a writer that dies before its rename
leaves the old version as it was, and of two writers on one version the second is refused. Upserts and deletes rewrite
the parts they touch, so a part's files stay as many as its rows need; appends add a folder, and ``compact`` merges
those. ``expire`` drops old manifests, and folders no kept one names once they are old enough to belong to no writer.

Only part names, paths and counts pass through the driver: one entry a part and folder.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.settle import settled
from tidemark.schemas import KEYS, schema
from tidemark.sources import archive

#: The column whose month (or year) names the part of a row.
BY_MONTH = {"quotes": "date", "external": "date", "ingest_log": "at", "features": "date"}
BY_YEAR = {"dividends": "ex_date", "fundamentals": "date"}
#: Tables derived from declared ones, which are kept as versions too.
DERIVED = {"features": T.StructType([T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("close", "momentum", "trend", "volatility", "liquidity")]])}
ROWS_A_FILE = 20_000_000


class ConflictError(RuntimeError):
    """Another writer has committed since the version that this one started from."""


def part_of(table: str) -> Column:
    if table in BY_MONTH:
        return F.coalesce(F.date_format(BY_MONTH[table], "yyyy-MM"), F.lit("none"))
    if table in BY_YEAR:
        return F.coalesce(F.date_format(BY_YEAR[table], "yyyy"), F.lit("none"))
    return F.lit("all")


def _kind(table: str) -> T.StructType:
    return DERIVED[table] if table in DERIVED else schema(table)


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, time of change in ms) of what lies in a folder; none if it is absent."""
    place, fs = _path(spark, folder)
    return [(x.getPath().getName(), x.getModificationTime()) for x in fs.listStatus(place)] if fs.exists(place) else []


def numbers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n, _ in _names(spark, f"{root}/commits") if n.endswith(".json"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The manifest of a version, by default the last; number 0 and no parts before the first commit."""
    if version is None:
        version = max(numbers(spark, root), default=0)
    if version == 0:
        return {"version": 0, "note": "", "batch": None, "parts": []}
    return json.loads(spark.read.text(f"{root}/commits/{version:012d}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, root: str, base: dict, parts: list[dict], note: str, batch: int | None = None) -> int:
    number = base["version"] + 1
    text = json.dumps({"version": number, "note": note, "batch": base["batch"] if batch is None else batch, "parts": sorted(parts, key=lambda p: (p["part"], p["path"]))})
    draft, fs = _path(spark, f"{root}/drafts/{uuid.uuid4().hex}.json")
    final, _ = _path(spark, f"{root}/commits/{number:012d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    fs.mkdirs(final.getParent())
    kinds = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
    except Exception as error:
        fs.delete(draft, False)
        if "FileAlreadyExists" not in str(error):
            raise
        raise ConflictError(f"version {number} of {root} was committed by another writer") from error
    return number


def _write(rows: DataFrame, root: str, table: str) -> list[dict]:
    """Writes rows below a new data folder and returns its parts; a large part is split over tasks."""
    folder = f"data/{uuid.uuid4().hex}"
    out = rows.withColumn("part", part_of(table)).hint("rebalance", "part")
    out.write.option("maxRecordsPerFile", ROWS_A_FILE).partitionBy("part").parquet(f"{root}/{folder}")
    spark = rows.sparkSession
    kind = T.StructType([*_kind(table).fields, T.StructField("part", T.StringType())])
    sessions = F.countDistinct("date") if "date" in kind.names else F.lit(0)
    counts = spark.read.schema(kind).parquet(f"{root}/{folder}").groupBy("part").agg(F.count("*").alias("rows"), sessions.alias("sessions")).collect()  # one a part
    return [{"part": r.part, "path": f"{folder}/part={r.part}", "rows": r.rows, "sessions": r.sessions} for r in counts]


def _rows(spark: SparkSession, root: str, table: str, parts: list[dict]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], _kind(table))
    return spark.read.schema(_kind(table)).parquet(*[f"{root}/{p['path']}" for p in parts])


def read(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the last; a table without commits is empty."""
    return _rows(spark, root, table, manifest(spark, root, version)["parts"])


def _rewrite(spark: SparkSession, root: str, table: str, base: dict, touched: set[str], change, note: str, batch: int | None = None) -> int:
    old = [p for p in base["parts"] if p["part"] in touched]
    written = _write(change(_rows(spark, root, table, old)), root, table)
    return _commit(spark, root, base, [p for p in base["parts"] if p["part"] not in touched] + written, note, batch)


def _touched(rows: DataFrame, table: str) -> set[str]:
    return {r.part for r in rows.select(part_of(table).alias("part")).distinct().collect()}  # names of parts


def upsert(root: str, table: str, new: DataFrame, order: str | None = None, note: str = "upsert", batch: int | None = None, base: dict | None = None) -> int:
    """Merges rows by key (see :func:`archive.upsert`) and returns the new version; a table without key is appended to."""
    spark = new.sparkSession
    base = manifest(spark, root) if base is None else base
    if not KEYS[table]:
        written = _write(archive.conform(new, table), root, table)
        return _commit(spark, root, base, base["parts"] + written, note, batch)
    new = settled(new, "new")
    return _rewrite(spark, root, table, base, _touched(new, table), lambda old: archive.upsert(old, new, table, order), note, batch)


def delete(root: str, table: str, keys: DataFrame, note: str = "delete", base: dict | None = None) -> int:
    """Removes the rows of the given keys; parts that lose all rows leave the version."""
    spark = keys.sparkSession
    base = manifest(spark, root) if base is None else base
    keys = settled(keys.select(*KEYS[table]), "keys")
    return _rewrite(spark, root, table, base, _touched(keys, table) & {p["part"] for p in base["parts"]}, lambda old: archive.delete_keys(old, keys, KEYS[table]), note)


def compact(spark: SparkSession, root: str, table: str, most: int = 4) -> int | None:
    """Rewrites parts that lie in more than ``most`` folders; the version it makes, None if there are no such parts."""
    base = manifest(spark, root)
    folders: dict[str, int] = {}
    for p in base["parts"]:
        folders[p["part"]] = folders.get(p["part"], 0) + 1
    crowded = {part for part, n in folders.items() if n > most}
    return _rewrite(spark, root, table, base, crowded, lambda old: old, "compact") if crowded else None


def expire(spark: SparkSession, root: str, keep: int = 10, least_age: float = 7 * 86400.0) -> int:
    """Drops all but the last ``keep`` manifests, then data folders that no kept one names and that are ``least_age`` seconds old.

    Returns the number of data folders removed.
    """
    known = numbers(spark, root)
    for number in known[:-keep]:
        place, fs = _path(spark, f"{root}/commits/{number:012d}.json")
        fs.delete(place, False)
    named = {p["path"] for number in known[-keep:] for p in manifest(spark, root, number)["parts"]}
    limit, removed = (time.time() - least_age) * 1000, 0
    for folder, changed in _names(spark, f"{root}/data"):
        if changed > limit:
            continue
        inside = [n for n, _ in _names(spark, f"{root}/data/{folder}") if n.startswith("part=")]
        lost = [n for n in inside if f"data/{folder}/{n}" not in named]
        for n in lost if len(lost) < len(inside) else [""]:
            place, fs = _path(spark, f"{root}/data/{folder}/{n}".rstrip("/"))
            removed += fs.delete(place, True)
    return removed


def read_parts(spark: SparkSession, root: str, table: str, names: set[str], version: int | None = None) -> DataFrame:
    """The rows of some parts of a version; the folders of others are not listed or read."""
    return _rows(spark, root, table, [p for p in manifest(spark, root, version)["parts"] if p["part"] in names])


def replace_parts(root: str, table: str, rows: DataFrame, names: set[str], note: str, batch: int | None = None) -> int:
    """A version in which ``rows`` are all that the parts ``names`` hold; other parts stay."""
    base = manifest(rows.sparkSession, root)
    written = _write(rows.filter(part_of(table).isin(*names)) if names else rows, root, table)
    return _commit(rows.sparkSession, root, base, [p for p in base["parts"] if p["part"] not in names] + written, note, batch)


def history(spark: SparkSession, root: str) -> DataFrame:
    """(version, note, parts, folders, rows) of every kept version, the latest last."""
    kind = "version long, note string, batch long, parts array<struct<part:string,path:string,rows:long>>"
    try:
        log = spark.read.schema(kind).json(f"{root}/commits")
    except PySparkException as error:  # only a table without commits has no history
        if "PATH_NOT_FOUND" not in str(error):
            raise
        log = spark.createDataFrame([], kind)
    names = F.transform("parts", lambda p: p["part"])
    rows = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["rows"])
    return log.select("version", "note", F.size(F.array_distinct(names)).alias("parts"), F.size("parts").alias("folders"), rows.alias("rows")).orderBy("version")
