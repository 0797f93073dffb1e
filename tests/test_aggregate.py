import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F
from test_joins import MASTERS, replicas

from runledger.operators import aggregate, joins


def brute_good(specs):
    """Good copies by nested loops over the locations of each run."""
    out = {}
    for run, group in itertools.groupby(sorted(specs, key=lambda s: (s[0], s[1])), key=lambda s: s[0]):
        docs = list(group)

        def master(kind, version):
            for _, _, host, t, v, status, checksum, _ in docs:
                if status == "transferred" and t == kind and (t, host, v) in (
                        ("raw", "P", None), ("raw", "T", None), ("processed", "Q", version)):
                    return checksum
            return None

        for _, _, host, t, v, status, checksum, has in docs:
            if status != "transferred" or t == "untriggered" or not has:
                continue
            n, good = out.get((run, t), (0, 0))
            out[run, t] = (n + 1, good + (host == "C" or checksum == master(t, v)))
    return sorted(((r, t, n, g) for (r, t), (n, g) in out.items()), key=repr)


def test_good_copies_against_loops(spark, rows):
    rng = random.Random(3)
    specs = []
    for run in range(150):
        for pos in range(rng.randrange(9)):
            kind = rng.choice(["raw", "processed", "untriggered"])
            specs.append((run, pos, rng.choice("PTQCX"), kind,
                          rng.choice(["v1", "v2"]) if kind == "processed" else rng.choice([None, None, "v1"]),
                          rng.choice(["transferred", "transferred", "error"]), rng.choice([None, "a", "b"]),
                          rng.random() < 0.8))
    assert rows(aggregate.good_copies(replicas(spark, *specs), MASTERS, "C")) == brute_good(specs)
    raw = aggregate.good_copies(replicas(spark, *specs), MASTERS, "C", "raw")
    assert rows(raw) == [r for r in brute_good(specs) if r[1] == "raw"]
    n_locations = joins.compare_checksums(replicas(spark, *specs), MASTERS, "C").count()
    assert n_locations == sum(r[2] for r in brute_good(specs))


def runs_with_events(spark, *specs):
    """Specs: (number, events, events per file, raw size)."""
    df = spark.createDataFrame(list(specs), "number long, events long, per long, raw_size_byte long")
    ini = F.struct(F.col("per").alias("events_per_file"))
    return df.select("number", F.struct(F.col("events").alias("events_built")).alias("trigger"),
                     F.struct(ini.alias("ini")).alias("reader"), "raw_size_byte")


@pytest.mark.parametrize("events,per,n_entries,complete", [
    (2500, None, 6, True), (2500, None, 7, True), (2500, None, 8, False), (2500, None, 5, False),
    (2500, 500, 9, True), (999, None, 4, True), (0, None, 4, None), (None, None, 4, None),
])
def test_completeness(spark, rows, events, per, n_entries, complete):
    runs = runs_with_events(spark, (1, events, per, None))
    reps = replicas(spark, (1, 0, "h", "raw", None, "transferred", None, True),
                    (1, 1, "gone", "raw", None, "transferred", None, True))
    files = spark.createDataFrame([("/h/1/0", 10)] * n_entries, "dir string, length long")
    out = rows(aggregate.completeness(runs, reps, files), "complete")
    assert out == ([] if complete is None else [(complete,)])
    size = rows(aggregate.raw_size(runs, reps, files), "raw_size_byte")
    assert size == [(10 * n_entries if complete else None,)]


def test_known_raw_size_is_kept(spark, rows):
    runs = runs_with_events(spark, (1, 2500, None, 77))
    reps = replicas(spark, (1, 0, "h", "raw", None, "transferred", None, True))
    files = spark.createDataFrame([("/h/1/0", 10)] * 6, "dir string, length long")
    assert rows(aggregate.raw_size(runs, reps, files), "raw_size_byte") == [(77,)]


def test_directory_digest_streams_sorted_digests(spark):
    data = [(f"d{i % 3}", hashlib.sha512(str(i).encode()).hexdigest()) for i in range(5000)]
    data += [("one", "ab")]
    out = {r.dir: (r.digest, r.n_files) for r in aggregate.directory_digest(
        spark.createDataFrame(data, "dir string, fingerprint string").repartition(7)).collect()}
    for d in ("d0", "d1", "d2", "one"):
        prints = sorted(f for name, f in data if name == d)
        assert out[d] == (hashlib.sha512("".join(prints).encode()).hexdigest(), len(prints))


def test_pretest_and_duplicates(spark, rows):
    files = spark.createDataFrame(
        [("a", "1", False), ("a", "1", False), ("a", "2", False), ("b", "1", True), ("c", "9", False), ("c", "8", True)],
        "dir string, fingerprint string, is_dir boolean")
    assert rows(aggregate.duplicate_files(files)) == [("a", "1", 2)]
    assert rows(aggregate.directory_pretest(files)) == [("a", 3, 0, "ok"), ("b", 0, 1, "error"), ("c", 1, 1, "error")]


def tree_by_hand(files, levels=3):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    nodes = {"": sorted(sha(f"{name}\n{fp}") for name, fp in files)}
    for n in range(1, levels + 1):
        nodes = {h[:n]: [x for x in rows if x[:n] == h[:n]] for rows in nodes.values() for h in rows}
    digests = {k: sha("".join(v)) for k, v in nodes.items()}
    for n in range(levels - 1, -1, -1):
        digests = {p: sha("".join(digests[k] for k in sorted(digests) if k[:n] == p)) for p in {k[:n] for k in digests}}
    return digests[""]


def test_tree_digest_of_a_hot_directory(spark, rows):
    hot = [("hot", f"f{n}", f"sum{n % 7}") for n in range(9000)]
    few = [("few", "a", "x"), ("few", "a", "x"), ("few", None, None)]
    files = spark.createDataFrame(hot + few, "dir string, name string, fingerprint string").repartition(6)
    expected = {"hot": tree_by_hand([f[1:] for f in hot]), "few": tree_by_hand([("a", "x"), ("a", "x"), ("", "")])}
    assert {r.dir: r.digest for r in aggregate.tree_digest(files).collect()} == expected
    nodes = aggregate.digest_nodes(files)
    assert nodes.filter("dir = 'hot' AND level = 3").count() > 3000  # leaves of a hot directory are many small groups
    changed = files.withColumn("fingerprint", F.when(F.col("name") == "f77", "other").otherwise(F.col("fingerprint")))
    assert aggregate.differing_leaves(nodes, aggregate.digest_nodes(changed)).count() in (1, 2)
    assert rows(aggregate.differing_leaves(nodes, nodes)) == []
    assert aggregate.tree_digest(files.limit(0)).count() == 0


def test_tree_digests_travel_as_bytes(spark):
    """A shuffle of the tree holds 32 bytes a digest, and the digests stay what they were."""
    files = spark.createDataFrame([("d", f"f{n}", "x") for n in range(40)], "dir string, name string, fingerprint string")
    out = aggregate.tree_digest(files)
    assert out.first().digest == tree_by_hand([(f"f{n}", "x") for n in range(40)])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex(sha2(" in plan
