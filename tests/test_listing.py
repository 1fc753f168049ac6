import datetime as dt

from rollscope.operators import executors as ex
from rollscope.operators import listing as ls
from rollscope.operators.tenant import TenantPolicy

D = dt.datetime
SCHEMA = ("id string, name string, attempts array<struct<attemptId:string, startTime:timestamp_ntz, "
          "endTime:timestamp_ntz, completed:boolean>>")


def apps(spark):
    rows = [
        ("a", "t1-a", [("2", D(2020, 1, 5), D(2020, 1, 6), True), ("1", D(2020, 1, 1), D(2020, 1, 2), False)]),
        ("b", "t1-b", [("1", D(2021, 3, 1), D(2021, 3, 2), True)]),
        ("c", "t1-c", [("1", D(2019, 6, 1), D(2019, 6, 2), False)]),
        ("d", "t2-d", []),
        ("e", "t1-e", [("1", D(2008, 1, 1), D(2008, 1, 2), True)]),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_two_completed_rules(spark):
    a = apps(spark)
    assert ids(ls.filter_status(a, ["running"])) == ["a", "c"]        # any attempt open
    assert ids(ls.filter_status(a, ["completed"])) == ["b", "d", "e"]
    assert ids(ls.filter_status(a, [])) == ["a", "b", "c", "d", "e"]
    assert ids(ls.completed_view(a, False)) == ["a", "b", "e"]        # newest attempt only
    assert ids(ls.completed_view(a, True)) == ["c", "d"]


def test_time_range(spark):
    a = apps(spark)
    # defaults: 2010 .. 3000; app e started 2008; app d has no attempt
    assert ids(ls.filter_time_range(a, now="2022-01-01")) == ["a", "b", "c"]
    # running apps pass the end test only when max_end > now
    got = ls.filter_time_range(a, min_end_date="2020-01-01", max_end_date="2021-12-31", now="2022-01-01")
    assert ids(got) == ["b"]
    got = ls.filter_time_range(a, min_end_date="2020-01-01", max_end_date="2021-12-31", now="2021-01-01")
    assert ids(got) == ["a", "b", "c"]


def test_order_limit_cap(spark):
    a = apps(spark)
    assert [r.id for r in ls.order_listing(a).collect()] == ["b", "a", "c", "e", "d"]
    assert [r.id for r in ls.limit_listing(a, 2).collect()] == ["b", "a"]
    assert ls.limit_listing(a, -3).count() == 0
    assert ls.limit_listing(a, None).count() == 5
    with_t = a.selectExpr("substring(name, 1, 2) AS tenant", "*")
    assert sorted(r.id for r in ls.cap(with_t, 1, partition_by="tenant").collect()) == ["b", "d"]


def test_application_query_and_summary(spark):
    a = apps(spark)
    pol = TenantPolicy.from_settings("true", "", "x")
    got = ls.application_query(a, "t1", pol, ["completed"], limit=5, now="2022-01-01")
    assert [r.id for r in got.collect()] == ["b"]
    got = ls.tenant_summary(a, "t1", pol, show_incomplete=True, max_apps=10)
    assert [r.id for r in got.collect()] == ["c"]
    tenants = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "tenant_id string")
    vis = {r.tenant_id: r.has_visible for r in ls.has_visible_apps(a, tenants, pol, True).collect()}
    assert vis == {"t1": True, "t2": True, "t3": False}


def test_executor_links(spark):
    a = apps(spark)
    e = spark.createDataFrame([("a", "driver", True, {"stdout": "x"}), ("a", "3", False, {}),
                               ("zz", "1", True, {})],
                              "app_id string, id string, isActive boolean, executorLogs map<string,string>")
    got = {(r.app_id, r.id): r.executorLogs for r in ex.executor_links(e, a, "/p").collect()}
    assert got[("a", "driver")] == {"logs": "/p/logPage/?appId=t1-a&podId=driver&logType=stderr"}
    assert got[("a", "3")] == {"logs": "/p/logPage/?appId=t1-a&podId=exec-3&logType=stderr"}
    assert got[("zz", "1")] == {"logs": "/p/logPage/?appId=null&podId=exec-1&logType=stderr"}
    assert ex.executor_links(e, a, active_only=True).count() == 2
    assert ex.executor(e, "3").count() == 1
