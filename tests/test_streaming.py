"""Streams against the same query over a batch, and late events."""

from datetime import datetime, timedelta
from pathlib import Path

from gradus.streaming import answers, autosave, jobs

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
START = datetime(2024, 1, 1)


def _write(spark, rows, at):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(at)


def _run(df, name, mode, spark, at):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{at}/state-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _rows(n=60):
    return [(i, START + timedelta(minutes=i), i % 3, "answer" if i % 2 else "mark", float(i)) for i in range(n)]


def test_last_write_wins_as_in_a_batch(spark, tmp_path):
    at = str(tmp_path / "in")
    _write(spark, _rows()[30:], at)  # newer events come first
    _write(spark, _rows()[:30], at)
    stream = _run(autosave.latest_answers(autosave.event_stream(spark, at, SCHEMA, 1)), "latest", "complete", spark, tmp_path)
    batch = autosave.latest_answers(spark.read.schema(SCHEMA).parquet(at))
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))
    assert {r["event_id"] for r in stream.collect()} == set(range(54, 60))


def test_rate_windows_count_what_the_watermark_closes(spark, tmp_path):
    at = str(tmp_path / "in")
    _write(spark, _rows(), at)
    _write(spark, [(99, START + timedelta(days=2), 0, "mark", 0.0)], at)  # closes the first hour
    out = _run(autosave.rate_windows(autosave.event_stream(spark, at, SCHEMA, 1)), "rates", "update", spark, tmp_path)
    newest = {}
    for r in out.collect():
        key = (r["user_id"], r["window_start"])
        newest[key] = max(newest.get(key, 0), r["requests"])
    assert sum(newest.values()) == 61 and len(newest) == 13
    assert all(n == 5 for (_, start), n in newest.items() if start < START + timedelta(days=1))


def test_stalled_jobs_are_resumed_and_given_up(spark, tmp_path):
    at = str(tmp_path / "in")
    beat = lambda i, seconds, user: (i, START + timedelta(seconds=seconds), user, "beat", 0.0)
    for rows in ([beat(0, 0, 1), beat(1, 0, 2)], [beat(2, 200, 2)], [beat(3, 210, 1)], [beat(4, 5000, 2)], [beat(5, 5001, 2)]):
        _write(spark, rows, at)
    out = _run(jobs.stalls(autosave.event_stream(spark, at, SCHEMA, 1)), "stalls", "append", spark, tmp_path)
    seen = [(r.state, r.resumes) for r in out.where("user_id = 1").collect()]
    assert ("resumed", 1) in seen and ("alive", 1) in seen and ("resumed", 2) in seen


def test_answers_merge_by_field(spark, tmp_path):
    at, into = str(tmp_path / "in"), str(tmp_path / "table")
    held = [(1, 1, "a", 1.0), (1, 2, "b", None), *((i, 1, "z", None) for i in range(2, 40))]
    jobs.answers_table(spark.createDataFrame(held, "attempt int, question int, choice string, number double"), into)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in Path(into).rglob("*.parquet")}
    before = files()
    schema = "attempt int, question int, seq int, given array<string>, choice string, number double"
    rows = [(1, 1, 1, ["choice"], "c", None), (1, 1, 3, ["number"], None, 7.0), (1, 1, 2, ["choice"], None, None), (1, 2, 1, ["number"], "x", 2.0), (1, 9, 1, ["choice"], "x", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(at)
    for _ in range(2):  # a second run finds nothing new
        jobs.merge_answers(spark.readStream.schema(schema).parquet(at), into, str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(into).drop("bucket")
    assert sorted(map(tuple, got.where("attempt = 1").collect())) == [(1, 1, None, 7.0), (1, 2, "b", 2.0)] and got.count() == len(held)
    own = spark.read.parquet(into).where("attempt = 1").first()["bucket"]
    changed = {f for f in before.keys() | files().keys() if before.get(f) != files().get(f)}
    assert changed and all(f"bucket={own}/" in f for f in changed)  # no other partition was written


def _answer_events():
    """Events with late, repeated and null answers, unknown fields and missing keys."""
    import random

    rng = random.Random(4)
    rows = []
    for seq in range(120):
        given = rng.sample(["selected_option", "numerical_answer", "text_answer", "other"], rng.randrange(0, 4))
        rows.append((rng.randrange(3), rng.randrange(4), seq, given, rng.choice((None, seq)), rng.choice((None, seq / 2)), rng.choice((None, f"t{seq}")), None))
    rng.shuffle(rows)
    return [*rows, *rows[:20], (None, 1, 5, ["text_answer"], None, None, "lost", None), (1, None, 5, ["text_answer"], None, None, "lost", None), (9, 9, 1, None, 1, 1.0, "x", 1)]


def test_answers_as_state(spark, tmp_path):
    """Batch after batch the state's answers are those of the fold over all events so far."""
    at, events = str(tmp_path / "in"), _answer_events()
    for k, v in answers.STORE.items():
        spark.conf.set(k, v)
    try:
        now, changed_in = {}, []
        for i in range(0, len(events), 50):
            spark.createDataFrame(events[i : i + 50], answers.EVENT).coalesce(2).write.mode("append").parquet(at)
            stream = answers.current_answers(spark.readStream.schema(answers.EVENT).parquet(at))
            batch = []
            q = stream.writeStream.foreachBatch(lambda b, _: batch.extend(map(tuple, b.collect()))).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination()
            now.update({r[:2]: r for r in batch})
            changed_in.append({r[:2] for r in batch})
            want = {r[:2]: r for r in map(tuple, answers.folded_answers(spark.createDataFrame(events[: i + 50], answers.EVENT)).collect())}
            assert now == want
        assert changed_in[-1] == {(r[0], r[1]) for r in events[100:] if None not in r[:2]}
    finally:
        for k in answers.STORE:
            spark.conf.unset(k)
