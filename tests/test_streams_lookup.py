import random
import tempfile
from datetime import datetime, timedelta

from hydrosift.operators import lookup as LK
from hydrosift.streaming import alerts as ST

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"
DAY = datetime(2024, 1, 1)


def _events(spark, folder, number, rows):
    """One file of events: (event_id, hours after DAY, site key, value)."""
    spark.createDataFrame([(i, DAY + timedelta(hours=h), u, "view", v) for i, h, u, v in rows], EVENTS).coalesce(1).write.parquet(
        f"{folder}/part={number}")


def _run(spark, folder, base):
    schema = spark.createDataFrame([], EVENTS).schema
    for q in ST.run_alert_stream(spark, f"{folder}/*", out_dir=base, schema=schema, only="episodes", gap="6 hours", watermark="12 hours")[0]:
        q.awaitTermination()
    return sorted((r.site[:9], r.first_ts, r.last_ts, r.n_alerts) for r in ST.read_episodes(spark, base).collect())


def test_one_message_per_episode_with_late_rows_and_a_restart(spark):
    folder, base = tempfile.mkdtemp(prefix="run-", dir="/tmp"), tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/out"
    bad, good = 400.0, 0.0

    def at(hours):
        return DAY + timedelta(hours=hours)
    # site 0 has two episodes (10 hours apart), site 1 one; a good reading is no alert
    _events(spark, folder, 1, [(1, 0, 0, bad), (2, 5, 0, bad), (3, 6, 0, good), (4, 15, 0, bad), (5, 1, 1, bad), (6, 1, 2, good)])
    first = _run(spark, folder, base)
    assert first == []  # the watermark stands at 3 hours
    # a restart finds the state; hour 20 continues site 0's second episode, hour 100 closes all but itself
    _events(spark, folder, 2, [(7, 20, 0, bad), (8, 100, 3, bad)])
    closed = [("Ghaggar R", at(0), at(5), 2), ("Ghaggar R", at(15), at(20), 2), ("Yamuna Ri", at(1), at(1), 1)]
    assert _run(spark, folder, base) == closed
    # hour 2 is far behind the watermark: no second message for that episode
    _events(spark, folder, 3, [(9, 2, 1, bad), (10, 200, 3, bad)])
    assert _run(spark, folder, base) == sorted([*closed, ("Agra Cana", at(100), at(100), 1)])
    assert _run(spark, folder, base) == sorted([*closed, ("Agra Cana", at(100), at(100), 1)])  # nothing new


def test_a_replayed_batch_writes_its_messages_once(spark):
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    alerts = spark.createDataFrame([("a", DAY, 250.0), ("a", DAY + timedelta(hours=1), 300.0), ("b", DAY, 210.0)],
                                   "site string, ts timestamp, wqi double")
    for _ in range(2):
        ST._sink(f"{base}/episodes")(ST.episode_rows(alerts), 4)
    got = sorted(ST.read_episodes(spark, base).collect())
    assert [(r.site, r.n_alerts, r.worst) for r in got] == [("a", 2, 300.0), ("b", 1, 210.0)]
    assert "300.00" in got[0].body


def test_classes_by_grams_equal_the_literal_form(spark):
    rnd = random.Random(2)

    def word():
        return "".join(rnd.choice("abC ") for _ in range(rnd.randrange(1, 6)))
    names = [" ".join(word() for _ in range(4)) for _ in range(60)] + ["", "  ", None, "zz", "aab", "aab"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, nearest_site string")
    for extra in ([], [(90, "", "empty")], [(-1, "", "empty")], [(91, None, "never")]):
        keys = [(i, word() + "c" * (i % 3), None if i == 7 else f"class {i}") for i in range(40)] + extra
        table = spark.createDataFrame(keys, "pos int, key string, wqi_class string")
        want = sorted(map(tuple, LK.nearest_site_class(df, classes=table).collect()))
        assert sorted(map(tuple, LK.nearest_site_class(df, classes=table, max_literal=0).collect())) == want
    none = LK._class_by_grams(df, "nearest_site", table.limit(0), "Unknown", "wqi_class")
    assert {r.wqi_class for r in none.collect()} == {"Unknown"} and none.count() == len(names)


def test_more_keys_than_the_literal_form_takes(spark):
    n = LK.MAX_LOOKUP_ROWS + 5
    table = spark.range(n).selectExpr("cast(id as int) pos", "concat('key ', id, ';') key", "concat('c', id) wqi_class")
    df = spark.createDataFrame([("at KEY 17; or key 3;",), (f"key {n - 1};",), (f"key {n};",)], "nearest_site string")
    got = [r.wqi_class for r in LK.nearest_site_class(df, classes=table).orderBy("nearest_site").collect()]
    assert got == ["c3", f"c{n - 1}", "Unknown"]
