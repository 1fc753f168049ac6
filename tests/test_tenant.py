"""Tenant rules, one test per trap."""

from rollscope.operators import tenant as tn
from rollscope.operators.tenant import TenantPolicy

APPS = [("1", "p1-job"), ("2", "p10-job"), ("3", "p2-x"), ("4", ""), ("5", "pnull-z"), ("6", "keep"),
        ("7", "q1-other")]


def apps_df(spark):
    return spark.createDataFrame([(i, n, []) for i, n in APPS],
                                 "id string, name string, attempts array<struct<attemptId:string, "
                                 "startTime:timestamp_ntz, endTime:timestamp_ntz, completed:boolean>>")


def listed(spark, tenant, policy):
    return sorted(r.id for r in tn.tenant_listing(apps_df(spark), tenant, policy).collect())


def python_visible(name, tenant, policy):
    if policy.enabled != "true":
        return True
    ex = policy.exclusions
    if not ex:
        return False
    if name in ex:
        return True
    t = "null" if tenant is None else tenant
    return any(name.startswith(p + t) for p in policy.patterns)


def test_prefix_collision_and_patterns(spark):
    pol = TenantPolicy.from_settings("true", "p,q", "keep")
    assert listed(spark, "1", pol) == ["1", "2", "6", "7"]          # T1: tenant 1 sees p10-job
    assert listed(spark, None, pol) == ["5", "6"]                    # T2: NULL tenant is "null"
    for t in ["1", "10", "2", None, ""]:
        exp = sorted(i for i, n in APPS if python_visible(n, t, pol))
        assert listed(spark, t, pol) == exp, t


def test_empty_exclusions_listing_vs_access(spark):
    pol = TenantPolicy.from_settings("true", "p", ",")               # T3: "," is an empty list
    assert pol.exclusions == []
    assert listed(spark, "1", pol) == []
    req = spark.createDataFrame([("r1", "1", "3"), ("r2", "1", "nope")], "request_id string, tenant_id string, "
                                                                        "app_id string")
    got = {r.request_id: r.decision for r in tn.tenant_access(req, apps_df(spark), pol).collect()}
    assert got == {"r1": "ok", "r2": "not_found"}


def test_defaults(spark):
    pol = TenantPolicy.from_settings()                               # T4 / T5 defaults
    assert pol.patterns == [""] and pol.exclusions == [""]
    assert listed(spark, "p1", pol) == ["1", "2", "4"]               # "" name visible to all; plain prefix


def test_flag_exact(spark):
    pol = TenantPolicy.from_settings("TRUE", "p", "keep")            # T6
    assert listed(spark, "zzz", pol) == [i for i, _ in sorted(APPS)]


def test_access_and_matrix(spark):
    pol = TenantPolicy.from_settings("true", "p", "keep")
    req = spark.createDataFrame([("a", "1", "2"), ("b", "3", "2"), ("c", "9", "6"), ("d", "1", "x")],
                                "request_id string, tenant_id string, app_id string")
    got = {r.request_id: r.decision for r in tn.tenant_access(req, apps_df(spark), pol).collect()}
    assert got == {"a": "ok", "b": "forbidden", "c": "ok", "d": "not_found"}
    tenants = spark.createDataFrame([("1",), ("10",), ("2",), (None,)], "tenant_id string")
    m = {(r.app_id, r.tenant_id): r.shared_prefix for r in tn.access_matrix(apps_df(spark), tenants, pol).collect()}
    assert m == {("1", "1"): False, ("2", "1"): True, ("2", "10"): False, ("3", "2"): False, ("5", None): False}
    audit = tn.access_audit(apps_df(spark), tenants, pol).collect()
    assert {(r.app_id, r.reason) for r in audit if r.tenant_id is None} == {("6", "exclusion"), ("5", "pattern")}
    pairs = spark.createDataFrame([("a", "1", "2"), ("b", "1", "6"), ("c", "1", "x")],
                                  "request_id string, tenant_id string, app_id string")
    vis = {r.request_id: (r.visible, r.reason) for r in tn.tenant_match(pairs, apps_df(spark), pol).collect()}
    assert vis == {"a": (True, "pattern"), "b": (True, "exclusion"), "c": (False, None)}


def test_exclusion_split(spark):
    pol = TenantPolicy.from_settings("true", "p", "keep,p2-x")
    exempt, subject = tn.exclusion_split(apps_df(spark), pol)
    assert sorted(r.id for r in exempt.collect()) == ["3", "6"]
    assert subject.count() == len(APPS) - 2


def test_policy_settings_absent():
    pol = TenantPolicy.from_settings(None, None, None)
    assert (pol.enabled, pol.patterns, pol.exclusions) == ("true", [""], [""])
    assert pol.filtering
    assert not TenantPolicy.from_settings(" true").filtering


def test_long_pattern_lists_give_what_short_ones_give(spark, monkeypatch):
    """Up to INLINE_PATTERNS patterns are tested in the row, more are joined: the same rows, odd values included."""
    from rollscope.operators import tenant as tn
    names = ["seg-1-a", "seg-10-b", "seg-1", "seg", "", None, "x-null-y", "open", "seg-1-a"]
    apps = spark.createDataFrame([(str(i), n, []) for i, n in enumerate(names)],
                                 "id string, name string, attempts array<struct<attemptId:string>>")
    tenants = ["1", "10", "", None]
    asked = [(f"r{i}-{t}", t, str(i)) for i in range(len(names) + 1) for t in tenants]
    pairs = spark.createDataFrame(asked + asked[:3], "request_id string, tenant_id string, app_id string")
    some = spark.createDataFrame([(t,) for t in tenants], "tenant_id string")
    relation = spark.createDataFrame([("seg-",), ("x-",), (None,), ("seg-",)], "p string")

    def answers(patterns, exclusions):
        p = tn.TenantPolicy("true", patterns, exclusions)
        out = [tn.tenant_match(pairs, apps, p), tn.tenant_access(pairs, apps, p), tn.access_audit(apps, some, p)]
        out += [tn.tenant_listing(apps, t, p).select("id", "name") for t in ("1", None)]
        return [sorted(map(repr, d.collect())) for d in out]

    cases = [(["seg-", "x-"], ["open"]), (relation, ["open"]), ([""], []), ([], ["open"])]
    short = [answers(*c) for c in cases]
    monkeypatch.setattr(tn, "INLINE_PATTERNS", -1)
    assert [answers(*c) for c in cases] == short
    assert short[0] == short[1]


def test_matrix_of_repeated_and_null_ids_without_a_table_of_pairs(spark):
    schema = "id string, name string, attempts array<struct<attemptId:string, startTime:timestamp_ntz, endTime:timestamp_ntz, completed:boolean>>"
    names = [("1", "p10-a"), ("1", "p10-a"), ("1", "p1-b"), (None, "p100"), (None, "q1"), ("2", "pp1"), ("3", "keep")]
    apps = spark.createDataFrame([(i, n, []) for i, n in names], schema)
    tenants = spark.createDataFrame([(t,) for t in ("1", "10", "100", None, "p1", "1")], "tenant_id string")
    found = tn.access_matrix(apps, tenants, TenantPolicy.from_settings("true", "p,,q", "keep"))
    pairs = [(i, n, p, t) for i, n in set(names) if n != "keep" for p in ("p", "q", "") for t in ("1", "10", "100", None, "p1")
             if n.startswith(p + ("null" if t is None else t))]
    size = lambda t: len("null" if t is None else t)
    want = {}
    for i, n, p, t in pairs:
        shared = size(t) < max(size(u) for j, _, q, u in pairs if (j, q) == (i, p))
        want[i, n, t] = want.get((i, n, t), False) or shared
    rows = found.collect()
    assert {(r.app_id, r.name, r.tenant_id): r.shared_prefix for r in rows} == want and len(rows) == len(want)
    assert "HashAggregate(keys=[app_id" not in found._jdf.queryExecution().executedPlan().toString()
