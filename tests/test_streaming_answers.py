"""The last answer of each key from a stream in several batches, against a plain computation."""

import datetime as dt
import random

from kinweave.streaming import answers

SCHEMA = "key string, answered timestamp, arrived timestamp, seq long, response string, n int"
T0 = dt.datetime(2024, 1, 1)


def plain(rows, minutes):
    out = {}
    for key, answered, arrived, seq, response, _ in rows:
        x = out.setdefault(key, [0, 0, (None, None, None)])
        late = answered is not None and arrived is not None and arrived - answered > dt.timedelta(minutes=minutes)
        x[0], x[1] = x[0] + 1, x[1] + late
        if not late and answered is not None and (x[2][0] is None or (answered, seq or 0) > x[2][:2]):
            x[2] = (answered, seq or 0, response)
    return {k: (n, late, *last) for k, (n, late, last) in out.items()}


def run(spark, folder, parts, files=1):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{folder}/in")
    states = answers.replayed(spark, f"file://{folder}/in", SCHEMA, lambda s: answers.last_answers(s, "10 MINUTES"), files)
    return states, {r["key"]: tuple(r)[1:] for r in answers.merged(states).collect()}


def test_batches_in_any_order_give_the_last_answers(spark, tmp_path):
    rng = random.Random(2)
    time = lambda m: T0 + dt.timedelta(minutes=m)
    rows = []
    for seq in range(600):
        m = rng.randrange(300)
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
        rows.append((key, time(m), time(m + rng.choice([0, 5, 10, 11, 90])), seq, f"r{seq}", 1))
    rows += [("late only", time(1), time(50), 1, "x", 1), ("no time", None, time(3), 2, "y", 1), ("no arrival", time(3), None, None, None, 1), ("tie", time(5), time(5), 7, "first", 1), ("tie", time(5), time(5), 9, "second", 1), ("tie", time(5), time(5), 8, "between", 1)]
    rng.shuffle(rows)
    states, got = run(spark, tmp_path, [rows[i::3] for i in range(3)])
    assert got == plain(rows, 10)
    assert got["tie"][-1] == "second" and got["late only"] == (1, 1, None, None, None)
    assert states.filter("key = 'hot'").count() == 3  # one state after each batch


def test_an_empty_stream_gives_no_rows(spark, tmp_path):
    assert run(spark, tmp_path, [[]])[1] == {}


def test_many_keys_need_no_python_call_each(spark, tmp_path):
    rows = spark.range(40_000).selectExpr("concat('k', id % 20000) AS key", "timestamp_seconds(id) AS answered", "timestamp_seconds(id) AS arrived", "id AS seq", "concat('r', id) AS response", "1 AS n")
    rows.repartition(2).write.parquet(f"file://{tmp_path}/in")
    plans = []
    states = answers.replayed(spark, f"file://{tmp_path}/in", SCHEMA, lambda s: plans.append(answers.last_answers(s, "10 MINUTES")) or plans[0], 1)
    got = answers.merged(states)
    assert got.count() == 20_000 and got.filter("n <> 2 or late <> 0 or seq < 20000 or response <> concat('r', seq)").isEmpty()
    assert "InPandas" not in plans[0]._jdf.queryExecution().analyzed().toString()
