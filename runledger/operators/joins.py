"""Joins: master copies, transfer pairs, ranges, intervals, inventories, rules, queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PROCESSED, RAW, REUPLOAD, TRANSFERRED, UNTRIGGERED
from ..scale import (broadcast_if_small, is_small, levels_for, node_of, point_nodes, range_pieces, run_time, scratch_dir,
                     split_by_keys, tasks_for)
from ..sources.catalogue import name_windows, number_ranges

Masters = Sequence[tuple[str, str, bool]]  # (type, host, compared per version?)
SECOND = 1_000_000  # microseconds
TASK_RANGES = 100_000  # ranges that a task cuts into pieces
LOCATION_FIELDS = ("pos", "host", "type", "version", "status", "location", "checksum")


# -- checksums --------------------------------------------------------------

def master_version(masters: Masters) -> Column:
    """Version that a replica's master must carry: its own, or none for unversioned types."""
    versioned = sorted({t for t, _, per_version in masters if per_version})
    return F.when(F.col("type").isin(versioned), F.col("version"))


def is_master(masters: Masters) -> Column:
    """Is this location one whose checksum is authoritative?"""
    hit = F.lit(False)
    for kind, host, per_version in masters:
        rule = (F.col("type") == kind) & (F.col("host") == host)
        hit = hit | (rule if per_version else rule & F.col("version").isNull())
    return hit


def master_checksum(replicas: DataFrame, masters: Masters) -> DataFrame:
    """Checksum of the first transferred master location per (run, type, version)."""
    rows = replicas.filter((F.col("status") == TRANSFERRED) & is_master(masters))
    return rows.groupBy("run_number", "type", master_version(masters).alias("version")).agg(
        F.min_by("checksum", "pos").alias("master_checksum"))


def with_master(replicas: DataFrame, masters: Masters, source: DataFrame | None = None) -> DataFrame:
    """Left-join the master checksum found in ``source`` (the same replicas by default)."""
    found = master_checksum(replicas if source is None else source, masters).select(
        F.col("run_number").alias("_run"), F.col("type").alias("_type"), F.col("version").alias("_version"),
        "master_checksum")
    left = replicas.withColumn("_mv", master_version(masters))
    return left.join(found, (F.col("run_number") == F.col("_run")) & (F.col("type") == F.col("_type"))
                     & F.col("_mv").eqNullSafe(F.col("_version")), "left").drop("_run", "_type", "_version", "_mv")


def comparable() -> Column:
    """Replicas that take part in a checksum comparison."""
    return F.coalesce((F.col("status") == TRANSFERRED) & F.col("has_checksum") & F.col("host").isNotNull()
                      & (F.col("type") != UNTRIGGERED), F.lit(False))


def compare_checksums(replicas: DataFrame, masters: Masters, catalogue: str) -> DataFrame:
    """Replica against master; a missing checksum equals a missing master, the catalogue always counts."""
    rows = with_master(replicas.filter(comparable()), masters, replicas)
    good = (F.col("host") == catalogue) | F.col("checksum").eqNullSafe(F.col("master_checksum"))
    return rows.withColumn("good", good).withColumn("no_master", F.col("master_checksum").isNull())


# -- transfers --------------------------------------------------------------

def here_there(replicas: DataFrame, here: str, remotes: Sequence[str], kind: str, direction: str,
               version: str | None = None, fields: Sequence[str] = LOCATION_FIELDS) -> DataFrame:
    """Last matching location here and at each remote, with its ``fields``: one row per (run, remote), in ``remotes`` order.

    One aggregation per run; the configured remotes are columns, not a join.
    """
    rows = replicas.filter((F.col("type") == kind) & F.col("host").isin([here, *remotes]))
    if kind == PROCESSED:
        rows = rows.filter(F.col("version") == version)
    ok = F.col("status") == TRANSFERRED
    at_here = F.col("host") == here
    entry = F.struct(*fields)
    aggs = [F.max_by(entry, F.when(at_here & ok if direction == "upload" else at_here, F.col("pos"))).alias("here")]
    for i, remote in enumerate(remotes):
        hit = (F.col("host") == remote) & ~at_here
        aggs.append(F.max_by(entry, F.when(hit & ok if direction == "download" else hit, F.col("pos"))).alias(f"_t{i}"))
    pairs = rows.groupBy("run_number").agg(*aggs)
    options = F.array(*[F.struct(F.lit(i).alias("option"), F.lit(r).alias("remote"), F.col(f"_t{i}").alias("there"))
                        for i, r in enumerate(remotes)])
    return pairs.select("run_number", F.lit(kind).alias("type"), "here", F.explode(options).alias("_o")).select(
        "run_number", "type", "here", "_o.*")


# -- ranges and intervals ---------------------------------------------------

def _first_per_node(ranges: DataFrame, lo: Column, hi: Column, levels: int) -> DataFrame:
    # A range is a small row of many pieces, which are sorted: so ranges are dealt to as many tasks as they need first.
    tasks = tasks_for(ranges.sparkSession, ranges.count(), TASK_RANGES)
    pieces = ranges.repartition(tasks, "min", "max", "pos").select("pos", "value", F.explode(range_pieces(lo, hi, levels)).alias("_p"))
    return pieces.groupBy("_p.level", "_p.node").agg(F.min_by("value", "pos").alias("value"), F.min("pos").alias("pos"))


def range_lookup(runs: DataFrame, ranges: DataFrame, number: str = "number", out: str = "value") -> DataFrame:
    """Value of the first half-open range [min, max) holding the number; null if none.

    Ranges are cut into tree nodes and every node keeps its first range, so a number meets
    at most one row per level however many ranges overlap.  With a small node table the
    levels are map-side lookups; otherwise numbers are exploded by level, and those that a
    range may hold are shuffled.
    """
    length = ranges.agg(F.max(F.col("max") - F.col("min"))).first()[0]
    levels = levels_for(length)
    nodes = _first_per_node(ranges, F.col("min"), F.col("max"), levels)
    path = scratch_dir(runs.sparkSession, "nodes")
    nodes.write.option("compression", "zstd").parquet(path)
    nodes = runs.sparkSession.read.schema(nodes.schema).parquet(path)
    if is_small(nodes):
        found = runs
        for n in range(levels):
            level = nodes.filter(F.col("level") == n).select(F.col("node").alias(f"_n{n}"), F.struct("pos", "value")
                                                             .alias(f"_v{n}"))
            found = found.join(F.broadcast(level), node_of(F.col(number), n) == F.col(f"_n{n}"), "left").drop(f"_n{n}")
        best = F.least(*[F.col(f"_v{n}") for n in range(levels)]) if levels > 1 else F.col("_v0")
        return found.select(*runs.columns, best["value"].alias(out))
    keyed = runs.select(number, F.explode(point_nodes(F.col(number), levels)).alias("_p")).select(number, "_p.*")
    keyed = split_by_keys(keyed, nodes, ["level", "node"], nodes.count())[1]  # most levels of a number have no range
    hits = keyed.join(nodes, ["level", "node"]).groupBy(number).agg(F.min_by("value", "pos").alias(out))
    return runs.join(hits, number, "left").select(*runs.columns, out)


def interval_sums(intervals: DataFrame, readings: DataFrame, key: str, sensor: str | None = None) -> DataFrame:
    """Count and sum of readings in [start, end] per interval, as differences of running totals.

    Readings are summed by time first.  Totals run inside a second, over the seconds of a day and over days, so no task
    sorts more than the times of a second, however dense they are, and dense times never multiply readings by intervals.
    An interval looks its two ends up and nothing between them.  Differences are taken inside a day, and of days only
    where an interval spans more than two, so that their error is that of a day's total, however long the history is.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bounds = intervals.agg(F.min("start").cast("string"), F.max("end").cast("string")).first()
    if bounds[0] is None or bounds[1] is None:
        return intervals.select(key).limit(0).selectExpr(key, "0L AS n", "0D AS total")
    kind = readings.schema["ts"].dataType
    rows = readings.filter(F.col("ts").between(*(F.lit(x).cast(kind) for x in bounds)))
    if sensor is not None:
        rows = rows.filter(F.col("sensor") == sensor)
    points = rows.select(micros("ts").alias("t"), "value").groupBy("t").agg(
        F.count("value").alias("n"), F.sum("value").alias("total"))
    ends = F.array(F.struct((micros("start") - 1).alias("t"), F.lit(False).alias("is_end")),
                   F.struct(micros("end").alias("t"), F.lit(True).alias("is_end")))
    asked = intervals.filter(F.col("start") <= F.col("end")).select(F.col(key).alias("key"), F.explode(ends).alias("_e")).select(
        "_e.t", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"), "key", "_e.is_end")
    both = points.unionByName(asked, allowMissingColumns=True).withColumns({
        "second": F.floor(F.col("t") / SECOND), "day": F.floor(F.col("t") / (86_400 * SECOND))})

    def running(partition: list[str], order: list[str], last: int) -> dict[str, Column]:
        window = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        return {f"{c}_before": F.coalesce(F.sum(c).over(window), F.lit(0)) for c in ("n", "total")}

    at = both.withColumns(running(["second"], ["t", F.col("is_end").isNotNull()], 0)).filter(F.col("is_end").isNotNull()).select(
        "key", "is_end", "second", "day", "n_before", "total_before")
    seconds = both.groupBy("day", "second").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    in_day = seconds.withColumns(running(["day"], ["second"], -1)).select(
        "second", F.col("n_before").alias("n_day"), F.col("total_before").alias("total_day"))
    days = seconds.groupBy("day").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    days = days.withColumns(running([], ["day"], -1)).withColumnsRenamed({"n": "n_whole", "total": "total_whole"}).select(
        "day", "n_whole", "total_whole", F.col("n_before").alias("n_days"), F.col("total_before").alias("total_days"))  # a row a day
    looked = at.join(in_day, "second").select(
        "key", "is_end", "day", *((F.col(f"{c}_before") + F.col(f"{c}_day")).alias(c) for c in ("n", "total"))).join(
        broadcast_if_small(days), "day")
    found = F.struct("day", "n", "total", "n_whole", "total_whole", "n_days", "total_days")
    pairs = looked.groupBy("key").agg(F.max(F.when(~F.col("is_end"), found)).alias("a"), F.max(F.when(F.col("is_end"), found)).alias("b"))

    def between(c: str) -> Column:
        a, b = F.col("a"), F.col("b")
        whole = b[f"{c}_days"] - (a[f"{c}_days"] + a[f"{c}_whole"])
        return F.when(a["day"] == b["day"], b[c] - a[c]).otherwise((a[f"{c}_whole"] - a[c]) + whole + b[c])

    return pairs.select(F.col("key").alias(key), between("n").alias("n"), between("total").alias("total")).filter("n > 0")


def interval_mean(runs: DataFrame, readings: DataFrame, sensor: str, key: str = "number") -> DataFrame:
    """Mean sensor value while a run was taken; null without readings."""
    sums = interval_sums(runs.filter(F.col("end").isNotNull()), readings, key, sensor)
    return runs.join(sums, key, "left").select(*runs.columns, (F.col("total") / F.col("n")).alias("mean_value"))


# -- inventories ------------------------------------------------------------

def find_strays(files: DataFrame, replicas: DataFrame, host: str, base: str) -> DataFrame:
    """Listed paths that are not registered at the host and whose directory is not registered either.

    Directories directly under the processing base are not strays.
    """
    known = replicas.filter(F.col("host") == host).select("location")
    rows = files.filter(~(F.col("is_dir") & (F.col("dir") == base)))
    rows = rows.join(known, F.col("dir") == F.col("location"), "left_anti")
    return rows.join(known, F.col("path") == F.col("location"), "left_anti")


def find_missing(replicas: DataFrame, paths: DataFrame, host: str) -> DataFrame:
    """Locations registered at the host that the listing does not hold."""
    listed = paths.select(F.col("path").alias("location")).distinct()
    return replicas.filter(F.col("host") == host).join(listed, "location", "left_anti")


def verify_download(downloaded: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Per dataset: files with equal fingerprints against both file counts."""
    side = lambda df, name: df.select("dataset", "file", F.lit(name).alias("_side"), "fingerprint")
    both = side(downloaded, "d").unionByName(side(catalogue, "c"))
    pick = lambda name: F.max(F.when(F.col("_side") == name, F.col("fingerprint")))
    has = lambda name: F.max(F.when(F.col("_side") == name, 1).otherwise(0))
    per_file = both.groupBy("dataset", "file").agg(
        pick("d").alias("_d"), pick("c").alias("_c"), has("d").alias("_nd"), has("c").alias("_nc"))
    out = per_file.groupBy("dataset").agg(
        F.sum("_nc").alias("n_catalogue"), F.sum("_nd").alias("n_downloaded"),
        F.count_if(F.col("_d") == F.col("_c")).alias("n_matched"))
    ok = (F.col("n_matched") == F.col("n_catalogue")) & (F.col("n_matched") == F.col("n_downloaded"))
    return out.withColumn("verified", ok)


def matched_uploads(local: DataFrame, catalogue: DataFrame, rse: str, check: bool = False) -> DataFrame:
    """Local files with their checksum at the endpoint, matched by name: (dataset, file, checksum, found).

    ``check`` also demands that the checksum equals the local ``fingerprint``.
    """
    mine = local.select("dataset", "file", F.lit(True).alias("_local"), F.lit(False).alias("_there"),
                        F.lit(None).cast("string").alias("checksum"), *([F.col("fingerprint").alias("_print")] if check else []))
    theirs = catalogue.filter(F.col("rse") == rse).select(
        "dataset", "file", F.lit(False), F.lit(True), "checksum", *([F.lit(None).cast("string")] if check else []))
    # The largest text of a group is found by sorting.  Rows are dealt first, as a name has but a few, so they are sorted once;
    # names begin alike, so a hash before them decides most comparisons.
    per_file = mine.union(theirs).repartition("dataset", "file").groupBy(F.xxhash64("dataset", "file").alias("_hash"), "dataset", "file").agg(
        F.bool_or("_local").alias("_local"), F.bool_or("_there").alias("_there"),
        F.max("checksum").alias("checksum"), *([F.max("_print").alias("_print")] if check else []))
    found = F.col("_there")
    if check:
        found = found & (F.col("checksum") == F.col("_print"))
    return per_file.filter("_local").select("dataset", "file", "checksum", F.coalesce(found, F.lit(False)).alias("found"))


def verify_upload(local: DataFrame, catalogue: DataFrame, rse: str, check: bool = False) -> DataFrame:
    """Upload state per dataset: every local file must be found by name at the endpoint.

    The checksums of a complete dataset are the rows of ``matched_uploads``.
    """
    out = matched_uploads(local, catalogue, rse, check).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if("found").alias("n_found"))
    status = F.when(F.col("n_found") == F.col("n_files"), TRANSFERRED).otherwise(REUPLOAD)
    return out.select("dataset", "n_files", "n_found", status.alias("status"))


# -- rules ------------------------------------------------------------------

SALT = 64
#: Classes of runs that only rules for all runs can take, and of other runs.
ALONE, EVERY = "alone-", "every-"


def run_classes(runs: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(number, class_id, but) of every run, and (class_id, rule_ids) of every list of rules that runs match.

    A run is in up to three classes: of the rules that name its number, of those with a window around its time, and of
    those that take all runs.  A rule of one class is in another one of the same run only if ``but`` holds it there.
    Windows are looked up once for each time that runs have, and lists of rules are kept per class, so what is shuffled
    grows with the runs and with the rules; pairs arise only when a caller joins members and classes.  A run that no
    number or window takes is in a class that starts with ``ALONE``, whose list may be empty.
    """
    numbers, windows = number_ranges(rules), _seconds(name_windows(rules))
    named = numbers.select("rule_id").distinct().withColumn("_named", F.lit(True))
    every = rules.select("rule_id", "run_name").join(named, "rule_id", "left").filter(
        F.col("_named").isNull() | (F.col("run_name") == "all")).select("rule_id").distinct()
    some = lambda ranges: ranges.join(broadcast_if_small(every), "rule_id", "left_anti")
    numbers, windows = some(numbers), some(windows)
    length = F.max(F.col("hi") - F.col("lo"))
    levels = {name: levels_for(ranges.agg(length).first()[0]) for name, ranges in (("number", numbers), ("_t", windows))}

    def looked_up(points: DataFrame, point: str, ranges: DataFrame, *keep: str) -> DataFrame:
        pieces = ranges.select("rule_id", F.explode(range_pieces(F.col("lo"), F.col("hi"), levels[point])).alias("_p"))
        nodes = points.select(*keep, F.explode(point_nodes(F.col(point), levels[point])).alias("_p"))
        return nodes.select(*keep, "_p.*").join(broadcast_if_small(pieces.select("rule_id", "_p.*")), ["level", "node"], "left")

    points = runs.select(F.col("number").cast("long").alias("number"),
                         F.unix_seconds(run_time(F.col("name")).cast("timestamp")).alias("_t"))
    named = looked_up(points, "number", numbers, "number", "_t").filter(F.col("rule_id").isNotNull() | (F.col("level") == 0))
    found = named.groupBy("number").agg(F.array_sort(F.collect_set("rule_id")).alias("_named"),
                                        F.array_sort(F.collect_set("_t")).alias("_times"))  # a run has one time
    times = found.select("_times").distinct().select("_times", F.explode("_times").alias("_t"))
    timed = looked_up(times, "_t", windows, "_times").groupBy("_times").agg(
        F.array_sort(F.collect_set("rule_id")).alias("_timed")).filter(F.size("_timed") > 0)
    found = found.join(timed, "_times", "left")

    def class_of(rule_ids: str) -> Column:
        return F.when(F.size(rule_ids) > 0, F.md5(F.to_json(rule_ids)))

    salt = F.pmod(F.xxhash64("number"), F.lit(SALT)).cast("string")
    alone = (F.size("_named") == 0) & F.col("_timed").isNull()
    none = F.array().cast(found.schema["_named"].dataType)
    kinds = [F.struct(class_of("_named").alias("class_id"), none.alias("but")),
             F.struct(class_of("_timed").alias("class_id"), F.coalesce(F.array_intersect("_named", "_timed"), none).alias("but")),
             F.struct(F.concat(F.when(alone, ALONE).otherwise(EVERY), salt).alias("class_id"), none.alias("but"))]
    members = found.select("number", F.explode(F.filter(F.array(*kinds), lambda k: k["class_id"].isNotNull())).alias("_k"))

    lists = found.filter(F.size("_named") > 0).select(F.col("_named").alias("rule_ids")).unionByName(
        timed.select(F.col("_timed").alias("rule_ids"))).distinct().select(class_of("rule_ids").alias("class_id"), "rule_ids")
    salted = F.explode(F.array(*[F.lit(f"{kind}{n}") for kind in (ALONE, EVERY) for n in range(SALT)]))
    taken = every.agg(F.collect_set("rule_id").alias("rule_ids")).select(salted.alias("class_id"), "rule_ids")
    return members.select("number", "_k.*"), lists.unionByName(taken)


def not_twice(pairs: DataFrame) -> DataFrame:
    """Pairs of ``run_classes`` without those that the run has from another class."""
    return pairs.filter(F.col("rule_id").isNull() | ~F.array_contains("but", F.col("rule_id"))).drop("but")


def match_rules(runs: DataFrame, rules: DataFrame, excludes: bool = False, detector: bool = False,
                source: bool = False) -> DataFrame:
    """(number, rule_id) pairs: number named or no number given, or name listed or in a window.

    Exclusions, detector and source are off by default.
    """
    members, classes = run_classes(runs, rules)
    pairs = members.join(classes.select("class_id", F.explode("rule_ids").alias("rule_id")), "class_id")
    found = not_twice(pairs).select("number", "rule_id")
    base = runs.select("number", F.unix_seconds(run_time(F.col("name")).cast("timestamp")).alias("_t"),
                       *(["detector"] if detector else []), *([F.col("source.type").alias("source_type")] if source else []))
    if excludes:
        gone = _point_matches(base, "number", number_ranges(rules, "run_nb_exclude"))
        barred = _seconds(name_windows(rules, "run_name_exclude"))
        gone = gone.unionByName(_point_matches(base, "_t", barred))
        found = found.join(gone, ["number", "rule_id"], "left_anti")
    for flag, mine, theirs in ((detector, "detector", "detector_type"), (source, "source_type", "source_type")):
        if flag:
            wanted = rules.select("rule_id", F.col(theirs).alias("_want"))
            found = found.join(wanted, "rule_id").join(base.select("number", F.col(mine).alias("_have")), "number")
            found = found.filter(F.col("_want").isNull() | (F.col("_want") == F.col("_have"))).select("number", "rule_id")
    return found


def _seconds(windows: DataFrame) -> DataFrame:
    """Windows as ranges [lo, hi) of seconds."""
    return windows.select("rule_id", F.unix_seconds(F.col("from_time").cast("timestamp")).alias("lo"),
                          (F.unix_seconds(F.col("to_time").cast("timestamp")) + 1).alias("hi"))


def _point_matches(runs: DataFrame, point: str, ranges: DataFrame) -> DataFrame:
    """(number, rule_id) for every range [lo, hi) that holds ``point``."""
    levels = levels_for(ranges.agg(F.max(F.col("hi") - F.col("lo"))).first()[0])
    pieces = ranges.select("rule_id", F.explode(range_pieces(F.col("lo"), F.col("hi"), levels)).alias("_p"))
    keyed = runs.filter(F.col(point).isNotNull()).select(
        "number", F.explode(point_nodes(F.col(point), levels)).alias("_p"))
    return keyed.select("number", "_p.*").join(
        broadcast_if_small(pieces.select("rule_id", "_p.*")), ["level", "node"]).select("number", "rule_id")


# -- work lists -------------------------------------------------------------

def not_queued(runs: DataFrame, queue: DataFrame, job_name: Column) -> DataFrame:
    """Runs whose job name is not in the queue snapshot."""
    return runs.withColumn("job_name", job_name).join(queue.select("job_name"), "job_name", "left_anti")


def not_processed(runs: DataFrame, replicas: DataFrame, host: str, version: str) -> DataFrame:
    """Runs without a processed location of the version at the host, whatever its status."""
    done = replicas.filter((F.col("host") == host) & (F.col("type") == PROCESSED) & (F.col("version") == version))
    return runs.join(done.select(F.col("run_number").alias("number")), "number", "left_anti")


def product_backlog(runs: DataFrame, products: Sequence[str], done: DataFrame) -> DataFrame:
    """(run, product) pairs still to make."""
    wanted = runs.select("number", "name", F.explode(F.array(*[F.lit(p) for p in products])).alias("product"))
    return wanted.join(done.select("number", "product"), ["number", "product"], "left_anti")


def raw_here(replicas: DataFrame, host: str) -> DataFrame:
    """Last transferred raw location at the host, per run."""
    rows = replicas.filter((F.col("host") == host) & (F.col("type") == RAW) & (F.col("status") == TRANSFERRED))
    return rows.groupBy(F.col("run_number").alias("number")).agg(F.max_by("location", "pos").alias("in_location"))
