"""Catalogue changes: each returns the new replica or run table.

Replicas are flat rows keyed by (run_number, pos), so a run with any number of locations
is changed row by row; ``explode_locations`` gives this form.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ERROR, TRANSFERRED, VERIFYING
from ..journal import create_entry, entry_names, read_entry, read_table, table_entry
from ..scale import is_small, may_match, scratch_dir

KEY = ("run_number", "pos")


def placed_locations(replicas: DataFrame, new: DataFrame) -> DataFrame:
    """New locations with their ``pos`` after the last of their run; ``new.ordinal`` orders the additions of one run."""
    last = replicas.groupBy("run_number").agg(F.max("pos").alias("_last"))
    return new.join(last, "run_number", "left").withColumn(
        "pos", F.coalesce("_last", F.lit(-1)) + 1 + F.col("ordinal")).drop("_last", "ordinal")


def push_locations(replicas: DataFrame, new: DataFrame) -> DataFrame:
    """Append locations to runs; ``new.ordinal`` orders the additions of one run."""
    return replicas.unionByName(placed_locations(replicas, new), allowMissingColumns=True)


def first_match(replicas: DataFrame, where: Column) -> DataFrame:
    """Key of the first matching location of each run."""
    return replicas.filter(where).groupBy("run_number").agg(F.min("pos").alias("pos"))


def set_location(replicas: DataFrame, updates: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Write ``fields`` of ``updates`` (keyed by run_number, pos) into the matching locations; nulls are written too."""
    new = updates.select(*KEY, F.struct(*fields).alias("_new"))
    out = replicas.join(new, list(KEY), "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.col("_new").isNotNull(), F.col("_new")[f]).otherwise(F.col(f)))
    return out.select(*replicas.columns)


def pull_locations(replicas: DataFrame, keys: DataFrame) -> DataFrame:
    """Drop every location equal to a key in all of the key's columns (nulls are equal)."""
    return _keyed(replicas, keys, "left_anti")


def pulled_locations(replicas: DataFrame, keys: DataFrame) -> DataFrame:
    """The locations that ``pull_locations`` drops."""
    return _keyed(replicas, keys, "left_semi")


def _keyed(replicas: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    keys = keys.distinct()
    names = keys.columns
    keys = keys.select(*[F.col(c).alias(f"_k_{c}") for c in names])
    same = F.lit(True)
    for c in names:
        mine, theirs = F.col(c), F.col(f"_k_{c}")
        same = same & (mine == theirs if c == "run_number" else mine.eqNullSafe(theirs))
    return replicas.join(keys, same, how)


def rename_location(replicas: DataFrame, host: str, moves: DataFrame) -> DataFrame:
    """Give the first location with path ``src`` at the host the path ``dst``, per run."""
    at = replicas.filter(F.col("host") == host).join(
        moves.select(F.col("src").alias("location"), F.col("dst").alias("_dst")), "location")
    first = at.groupBy("run_number", "location").agg(F.min("pos").alias("pos"), F.min("_dst").alias("_dst"))
    return set_location(replicas, first.select("run_number", "pos", F.col("_dst").alias("location")), ["location"])


def remove_location(replicas: DataFrame, host: str, paths: DataFrame, status: str | None = None) -> DataFrame:
    """Drop the first location with a listed path at the host, per run and path."""
    return replicas.join(first_at(replicas, host, paths, status), list(KEY), "left_anti")


def first_at(replicas: DataFrame, host: str, paths: DataFrame, status: str | None = None) -> DataFrame:
    """Key of the first location with a listed path at the host, per run and path."""
    rows = replicas.filter(F.col("host") == host)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    first = rows.join(paths.select("location").distinct(), "location").groupBy("run_number", "location").agg(
        F.min("pos").alias("pos"))
    return first.select(*KEY)


def set_run_column(runs: DataFrame, values: DataFrame, column: str, version_name: str) -> DataFrame:
    """Write ``values.value`` into a column of the runs, also nulls, and ``values.version`` as its correction version."""
    new = values.select("number", F.struct(F.col("value").alias("value"), F.col("version").alias("version")).alias("_new"))
    out = runs.join(new, "number", "left")
    old = F.coalesce("correction_versions", F.create_map().cast("map<string,string>"))
    versions = F.map_concat(F.map_filter(old, lambda k, _: k != version_name),
                            F.create_map(F.lit(version_name), F.col("_new.version")))
    hit = F.col("_new").isNotNull()
    before = F.col(column) if column in runs.columns else F.lit(None)
    out = out.withColumns({column: F.when(hit, F.col("_new.value")).otherwise(before),
                           "correction_versions": F.when(hit, versions).otherwise(F.col("correction_versions"))})
    return out.select(*runs.columns, *([] if column in runs.columns else [column]))


def set_run_field(runs: DataFrame, values: DataFrame, param: str, version_name: str) -> DataFrame:
    """Write ``values.value`` as a run parameter, and ``values.version`` as its correction version."""
    new = values.select("number", F.col("value").alias("_value"), F.col("version").alias("_version"),
                        F.lit(True).alias("_hit"))
    out = runs.join(new, "number", "left")

    def put(name, key, value, kind):
        old = F.coalesce(F.col(name), F.create_map().cast(kind))
        rest = F.map_filter(old, lambda k, _: k != key)
        return F.when(F.col("_hit"), F.map_concat(rest, F.create_map(F.lit(key), value))).otherwise(F.col(name))

    out = out.withColumn("params", put("params", param, F.col("_value").cast("double"), "map<string,double>"))
    out = out.withColumn("correction_versions",
                         put("correction_versions", version_name, F.col("_version"), "map<string,string>"))
    return out.select(*runs.columns)


class Conflict(RuntimeError):
    """Somebody else committed first."""


def write_version(df: DataFrame, path: str, dry_run: bool = False, expected: int | None = None) -> int:
    """Write a whole new version, then the entry that makes it current; returns the version.

    The data lie in a folder of their own, and a version's entry is created at most once, so no writer ever replaces
    another's rows, and a job that dies half-way leaves the old version current.  Writers at the same time get versions
    one after the other.  With ``expected``, the version that ``df`` was derived from, a writer that is late raises
    ``Conflict`` instead and writes nothing current.  ``dry_run`` writes nothing.
    """
    spark = df.sparkSession
    version = (current_version(spark, path) or 0) + 1
    if expected is not None and version != expected + 1:
        raise Conflict(f"version {expected} is not the newest")
    if dry_run:
        return version
    data = f"{path}/data/{uuid.uuid4().hex}"
    df.write.parquet(data)
    while not create_entry(spark, f"{path}/versions", f"{version:012d}", table_entry(df, data)):
        if expected is not None:
            raise Conflict(f"version {expected} is not the newest")
        version += 1
    return version


def current_version(spark: SparkSession, path: str) -> int | None:
    names = entry_names(spark, f"{path}/versions")
    return int(names[-1]) if names else None


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    version = version or current_version(spark, path)
    if version is None:
        raise ValueError(f"no version at {path}")
    return read_table(spark, read_entry(spark, f"{path}/versions", f"{version:012d}"))


def to_verify(host: str, aliases: Sequence[str] = ()) -> str:
    """Condition, in SQL, of the locations that ``add_checksum`` may change: those to verify, or with no host or status."""
    names = ", ".join("'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'" for name in (host, *aliases))
    return f"coalesce(host IN ({names}) AND status = '{VERIFYING}', true)"


def add_checksum(replicas: DataFrame, digests: DataFrame, host: str, aliases: Sequence[str] = (),
                 recheck: bool = False, twice: DataFrame | None = None) -> DataFrame:
    """Verify local locations: the digest makes them transferred, a missing file an error.

    Only ``verifying`` locations change; ``recheck`` also flags transferred ones whose
    digest differs or is missing in ``checksumproblem``.  ``twice`` is what ``found_twice`` gives, if it is known.
    """
    found = digests.select("location", F.col("digest").alias("_digest"))
    local = F.col("host").isin([host, *aliases])
    todo = local & (F.col("status") == VERIFYING)
    known = {} if twice is None else {"twice": twice}
    out = replicas.join(found, "location", "left") if recheck else _with_digests(replicas, found, todo, **known)
    digest = F.col("_digest")
    if recheck:
        bad = local & (F.col("status") == TRANSFERRED) & ~digest.eqNullSafe(F.col("checksum"))
        old = F.col("checksumproblem") if "checksumproblem" in replicas.columns else F.lit(None).cast("boolean")
        out = out.withColumn("checksumproblem", F.when(bad | (local & (F.col("status") == TRANSFERRED) & digest.isNull()),
                                                       True).otherwise(old))
    status = F.when(todo, F.when(digest.isNull(), ERROR).otherwise(TRANSFERRED)).otherwise(F.col("status"))
    out = out.withColumns({
        "checksum": F.when(todo, digest).otherwise(F.col("checksum")),
        "has_checksum": F.col("has_checksum") | todo,
        "status": status,
    })
    return out.select(*replicas.columns, *(["checksumproblem"] if recheck and "checksumproblem" not in replicas.columns else []))


def _with_digests(replicas: DataFrame, found: DataFrame, todo: Column, twice: DataFrame | None = None) -> DataFrame:
    """The replicas joined with their digests, or with none where that makes no difference.

    It makes one to rows of ``todo``, and to rows whose location is found several times, which come back as often.
    """
    twice = found_twice(found) if twice is None else twice
    if not is_small(twice):
        return replicas.join(found, "location", "left")
    marked = replicas.join(F.broadcast(twice.withColumn("_twice", F.lit(True))), F.xxhash64("location") == F.col("_code"), "left")
    asked = F.coalesce(todo, F.lit(False)) | F.col("_twice").isNotNull()
    kind = found.schema["_digest"].dataType
    rest = marked.filter(~asked).select(*replicas.columns, F.lit(None).cast(kind).alias("_digest"))
    rows = marked.filter(asked).select(*replicas.columns)
    near = may_match(found, rows, ["location"])
    return rows.join(near, "location", "left").select(*replicas.columns, "_digest").unionByName(rest)


def found_twice(digests: DataFrame) -> DataFrame:
    """Codes of the locations with several digests, stored."""
    path = scratch_dir(digests.sparkSession, "found-twice")
    digests.filter(F.col("location").isNotNull()).groupBy(F.xxhash64("location").alias("_code")).agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1").select("_code").write.parquet(path)
    return digests.sparkSession.read.schema("_code long").parquet(path)


def backfill_checksum(replicas: DataFrame, digests: DataFrame, primary: str, tape: str,
                      require_match: bool = False) -> DataFrame:
    """Give transferred tape locations without checksum their digest.

    ``require_match`` demands that the last primary checksum before it equals the digest.
    """
    out = replicas.join(digests.select("location", F.col("digest").alias("_digest")), "location", "left")
    fill = ((F.col("host") == tape) & F.col("checksum").isNull() & (F.col("status") == TRANSFERRED)
            & F.col("_digest").isNotNull())
    if require_match:
        prime = replicas.filter(F.col("host") == primary).groupBy("run_number").agg(
            F.max_by("checksum", "pos").alias("_primary"))
        out = out.join(prime, "run_number", "left")
        fill = fill & (F.col("_primary") == F.col("_digest"))
    out = out.withColumn("has_checksum", F.col("has_checksum") | fill).withColumn(
        "checksum", F.when(fill, F.col("_digest")).otherwise(F.col("checksum")))
    return out.select(*replicas.columns)
