import itertools

import pytest
from pyspark.sql import functions as F

from runledger.operators import endpoints, joins
from runledger.plans import rules as plans
from runledger.sources import catalogue

RULE = ("rule_id long, verification_only boolean, run_nb string, run_nb_exclude string, run_name string, "
        "run_name_exclude string, detector_type string, source_type string, destination_rse array<string>, "
        "destination_livetime map<string,string>, remove_rse array<string>")


def rule(i, run_nb=None, run_name=None, verify=False, rse=("r0",), live=None, remove=None, **extra):
    return (i, verify, run_nb, extra.get("run_nb_exclude"), run_name, extra.get("run_name_exclude"),
            extra.get("detector_type"), extra.get("source_type"), list(rse), live or {r: "-1" for r in rse}, remove)


@pytest.fixture
def runs(spark):
    return spark.sql("""SELECT id AS number, concat('1608', lpad(id, 2, '0'), '_0125') AS name,
      if(id % 2 = 0, 'tpc', 'muon_veto') AS detector, struct('AmBe' AS type) AS source FROM range(1, 11)""")


@pytest.mark.parametrize("text,expected", [
    ("5-8", [5, 6, 7]), ("8-5", []), (" 1 , 2,, 3-5 ", [1, 2, 3, 4]), (None, []), ("4", [4]),
])
def test_number_sets(spark, text, expected):
    df = spark.createDataFrame([rule(1, text)], RULE)
    assert sorted(r.number for r in catalogue.rule_numbers(df).collect()) == expected


def matched(runs, spark, *rules, **flags):
    out = joins.match_rules(runs, spark.createDataFrame(list(rules), RULE), **flags)
    return {i: sorted(r.number for r in g) for i, g in itertools.groupby(
        sorted(out.collect(), key=lambda r: r.rule_id), key=lambda r: r.rule_id)}


def test_matching(spark, runs):
    got = matched(runs, spark, rule(1, "2-4, 9"), rule(2), rule(3, "99", "160805_0125, 160807_0000-160808_0125"),
                  rule(4, "99", "all"), rule(5, "8-5"), rule(6, "99"))
    every = list(range(1, 11))
    assert got == {1: [2, 3, 9], 2: every, 3: [5, 7, 8], 4: every, 5: every}


def test_optional_restrictions(spark, runs):
    r = rule(1, "1-9", run_nb_exclude="2-4", run_name_exclude="160805_0125", detector_type="tpc", source_type="AmBe")
    assert matched(runs, spark, r) == {1: [1, 2, 3, 4, 5, 6, 7, 8]}
    assert matched(runs, spark, r, excludes=True) == {1: [1, 4, 6, 7, 8]}
    assert matched(runs, spark, r, detector=True, source=True) == {1: [2, 4, 6, 8]}


def test_targets(spark, runs, rows):
    df = spark.createDataFrame([rule(1, "1", rse=("r0", "r2"), live={"r0": "3600", "r2": "-1"}, remove=["r1"])], RULE)
    out = plans.rule_targets(runs.filter("number < 3"), df, ["r0", "r1"])
    assert rows(out) == [(1, 1, "r0", "3600", ["r1"]), (1, 1, "r2", "-1", ["r1"]), (2, None, "r0", "-2", []),
                         (2, None, "r1", "-2", [])]


def test_verification_only_skips_unmatched(spark, runs, rows):
    df = spark.createDataFrame([rule(1, "1", verify=True, remove=["r1"])], RULE)
    out = plans.rule_targets(runs.filter("number < 3"), df, ["r0", "r1"])
    assert rows(out) == [(1, 1, "r0", "-2", []), (1, 1, "r1", "-2", [])]


@pytest.mark.parametrize("lifetime,existing,status,remove,action", [
    ("3600", "OK", "transferred", [], "update"), ("-1", "OK", "transferred", [], "keep"),
    ("3600", "REPLICATING", "transferred", [], "wait"), ("3600", "STUCK[1]", "transferred", [], "wait"),
    ("-2", None, "transferred", [], "verify"), ("-1", None, "transferred", [], "add_permanent"),
    ("0", None, "transferred", [], "add_lifetime"), ("3600", None, "error", [], "skip"),
    ("3600", "OK", "transferred", ["x"], "skip"),
])
def test_actions(spark, lifetime, existing, status, remove, action):
    targets = spark.createDataFrame([(1, "s:n", "r0", lifetime, remove, status)],
                                    "number long, did string, rse string, lifetime string, remove array<string>, status string")
    known = spark.createDataFrame([("s:n", "r0", "id", existing)] if existing else [],
                                  "did string, rse string, rule_id string, status string")
    assert plans.rule_actions(targets, known).first().action == action


def test_lifetime_changes(spark, rows):
    known = spark.createDataFrame([("a", "OK"), ("b", "STUCK"), (None, "OK")], "rule_id string, status string")
    act = lambda *a, **k: [r.action for r in plans.lifetime_changes(known, *a, **k).collect()]
    assert act(10) == ["update", "none", "none"]
    assert act(10, force=True) == ["update", "update", "none"]
    assert act(0, force=True) == ["none", "none", "none"]


def test_deletes_need_all_endpoints(spark, rows):
    locations = spark.createDataFrame([("a", ["r0", "r1"], ["r0"]), ("b", ["r1"], ["r0", "r1"]), ("c", ["r1"], [])],
                                      "did string, rse array<string>, remove array<string>")
    known = spark.createDataFrame([("a", "r0", "1"), ("b", "r1", "2")], "did string, rse string, rule_id string")
    assert rows(plans.rule_deletes(locations, known)) == [("a", "r0", "1")]


def test_endpoint_sets(spark, rows):
    reps = spark.createDataFrame(
        [(1, 0, "ok", "l", ["a"]), (2, 0, "ok", "l", ["a", "b"]), (3, 0, "bad", "l", []), (4, 0, "ok", "l", None)],
        "run_number long, pos long, status string, location string, rse array<string>")
    runs_of = lambda df: [r[0] for r in rows(df, "run_number")]
    assert runs_of(endpoints.rse_copies(reps, 2)) == [2]
    assert runs_of(endpoints.rse_copies(reps, 0)) == [3]
    assert runs_of(endpoints.rse_single(reps, ["a"])) == [1]
    assert runs_of(endpoints.rse_multiple(reps, ["a"])) == [2]
    assert rows(endpoints.rse_report(reps, "ok"), "run_number", "rse") == [(1, "a"), (2, "a, b")]
    assert rows(endpoints.rse_remaining(reps, ["a"]), "run_number", "applied", "remaining") == [
        (1, True, []), (2, True, ["b"]), (3, False, [])]


def test_random_endpoint_keeps_its_lifetime(spark):
    df = spark.createDataFrame([rule(7, rse=("r0", "random: x, y"), live={"r0": "1", "random: x, y": "2"})], RULE)
    one, two = endpoints.choose_rse(df, "s").first(), endpoints.choose_rse(df, "s").first()
    assert one == two and one.destination_rse[0] == "r0" and one.destination_rse[1] in ("x", "y")
    assert one.destination_livetime == {"r0": "1", one.destination_rse[1]: "2"}


def test_windows_are_looked_up_once_a_time(spark, rows):
    """Lists of windows are kept per time, not per run, and a rule that takes a run twice counts once."""
    runs = spark.sql("SELECT id AS number, concat('16080', 1 + id % 3, '_0125') AS name FROM range(1, 301)")
    runs = runs.union(runs.filter("number = 7")).union(spark.createDataFrame([(None, "160801_0125"), (8, None)], "number long, name string"))
    days = [rule(10 + i, "7", "160801_0000-160802_2359") for i in range(20)] + [rule(50, "9-12"), rule(51, "1", "all"), rule(52, "400")]
    df = spark.createDataFrame(days, RULE)
    members, classes = joins.run_classes(runs, df)
    sizes = [len(r.rule_ids) for r in classes.collect() if not r.class_id.startswith((joins.ALONE, joins.EVERY))]
    assert sorted(sizes) == [1, 20]  # rule 50, and the days' rules: for number 7 and for two of the three times
    got = rows(joins.match_rules(runs, df), "number", "rule_id")
    windows = [n for n in range(1, 301) if n % 3 < 2]
    assert got == sorted([*((n, 51) for n in [*range(1, 301), None]), *((n, 50) for n in (9, 10, 11)),
                          *((n, 10 + i) for n in [*windows, None] for i in range(20))], key=repr)


def test_actions_from_known_rules(spark, runs, rows):
    """What is known of a run joins before its targets are made; the actions are those of a join with all targets."""
    df = spark.createDataFrame([rule(i, "1-5", rse=("r0", "r2")) for i in range(4)] + [rule(9, "3", verify=True)], RULE)
    known = spark.createDataFrame([("s:1", "r0", "a", "OK"), ("s:1", "r0", "b", "STUCK"), ("s:2", "r9", "c", "OK"),
                                   ("s:7", "r1", "d", "OK"), ("s:3", None, "e", "OK")], "did string, rse string, rule_id string, status string")
    did = F.concat(F.lit("s:"), F.col("number").cast("string"))
    ready = lambda t: t.withColumnRenamed("rule_id", "rule").withColumn("status", F.lit("transferred"))
    late = plans.rule_actions(ready(plans.rule_targets(runs, df, ["r0", "r1"])).withColumn("did", did), known)
    early = plans.rule_actions(ready(plans.rule_targets(runs, df, ["r0", "r1"], lambda m: plans.with_known(m.withColumn("did", did), known))))
    columns = ["number", "rule", "rse", "rule_id", "rule_status", "action"]
    assert rows(early, *columns) == rows(late, *columns) and early.count() > 40


def test_actions_once_for_rules_that_ask_the_same(spark, rows):
    """Actions are found once for all rules of a list that ask the same; the rows are those of an action per target."""
    runs = spark.createDataFrame([*((n, f"16080{1 + n % 3}_0125") for n in [*range(1, 9), 8]), (None, "160801_0125"), (9, None)],
                                 "number long, name string")
    kinds = [rule(20 + i, "4, 5", "160801_0000-160802_2359", rse=("r0", "r2"), live={"r0": "3600"}, remove=["r1"] if i % 2 else None)
             for i in range(30)] + [rule(1, "2-4", verify=True), rule(1, "2-4"), rule(2, "3", rse=()), rule(3, "5", "all", rse=("r0", None), live={"r0": "-1"})]
    known = spark.createDataFrame([("s:1", "r0", "a", "OK"), ("s:1", "r0", "b", "STUCK"), ("s:4", "r2", "c", "OK"), ("s:7", "r1", "d", "OK"),
                                   (None, "r0", "e", "OK")], "did string, rse string, rule_id string, status string")
    did = F.concat(F.lit("s:"), F.col("number").cast("string"))
    ready = lambda t: t.withColumn("status", F.when(F.col("number") % 3 == 0, "error").otherwise("transferred"))
    of_runs = lambda m: plans.with_known(m.withColumn("did", did), known)
    columns = ["number", "rule", "rse", "lifetime", "remove", "rule_status", "action"]
    for rules in (kinds, kinds[:-1], [rule(1, "2", verify=True)]):
        df, given = spark.createDataFrame(rules, RULE), []

        def act(targets):
            given.append(targets)
            return plans.rule_actions(ready(targets)).drop("rule_id")

        late = plans.rule_actions(ready(plans.rule_targets(runs, df, ["r0", "r1"], of_runs).withColumnRenamed("rule_id", "rule")))
        early = plans.rule_targets(runs, df, ["r0", "r1"], of_runs, act).withColumnRenamed("rule_id", "rule")
        assert rows(early, *columns) == rows(late, *columns)
        assert "rule_id" not in given[0].columns
        if rules is kinds:
            assert given[0].count() * 4 < early.count()
