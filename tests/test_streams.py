"""Streams that stop, go on, run a batch again, and race."""

import datetime
import os
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from chronolith.operators.tokens import token_windows
from chronolith.streaming import logtail, scan, windows


def test_windows_carry_tokens_over_batches(spark, tmp_path):
    """Three batches make the windows of one, also where a batch ends inside a window or holds nothing of a key."""
    rng = random.Random(4)
    rows, time = [], {"a": 0, "b": 0, "c": 0}
    for batch, keys in enumerate(("aab", "abb", "aac")):
        for k in range(30):
            key = rng.choice(keys)
            time[key] += rng.randrange(3)
            rows.append((batch, f"{batch}{k:03d}", key, 1000 * batch + time[key], " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 2, 5, 9, 40])))))
    df = spark.createDataFrame(rows, "batch int, id string, part string, created_utc long, text string")
    want = sorted(map(tuple, token_windows(df, ["part"], ["created_utc", "id"], stride=8).collect()))
    out = f"{tmp_path}/out"
    for batch in range(3):
        df.filter(F.col("batch") == batch).write.parquet(f"{tmp_path}/in/{batch}")
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        windows.packed_stream(stream, ["part"], ["created_utc", "id"], out, stride=8)
        made = windows.packed_windows(spark, out).select("part", "window_no", "tokens", "created_utc")
        assert made.count() < len(want) or batch == 2
    assert sorted(map(tuple, made.collect())) == want and len({w[0] for w in want}) == 3


def test_new_parts_are_queued_once(spark, tmp_path):
    folder, queue = f"{tmp_path}/audits", f"{tmp_path}/queue"
    audit = lambda at, *rows: spark.createDataFrame(list(rows), scan.AUDIT).coalesce(1).write.json(f"{folder}/{at}")
    packed = spark.createDataFrame([("p0",)], "part string")

    def run():
        scan.queue_new(scan.audits(spark, folder), ["part"], packed, queue)
        return sorted(r["part"] for r in scan.queued(spark, queue).collect())

    audit(1, ("p0", "complete", "2"), ("p1", "complete", "2"), ("p2", "missing_source", "2"), ("p3", None, "2"), ("p1", "complete", "2"))
    assert run() == ["p1", "p3"] and run() == ["p1", "p3"]
    audit(2, ("p1", "complete", "2"), ("p4", "complete", "2"))
    assert run() == ["p1", "p3", "p4"]
    last = max(int(x) for x in os.listdir(f"{queue}-progress/commits") if x.isdigit())
    for name in (f"{last}", f".{last}.crc"):  # the driver was lost before the batch was committed: it runs again
        if os.path.exists(f"{queue}-progress/commits/{name}"):
            os.remove(f"{queue}-progress/commits/{name}")
    assert run() == ["p1", "p3", "p4"]


def test_one_of_many_claims(spark, tmp_path):
    marker = f"file://{tmp_path}/deep/launched"
    with ThreadPoolExecutor(8) as pool:
        said = list(pool.map(lambda k: scan.claim(spark, marker, f"s{k}"), range(8)))
    assert sum(said) == 1
    winner = said.index(True)
    assert scan.claim(spark, marker, f"s{winner}") and not scan.claim(spark, marker, "s99")
    assert os.listdir(f"{tmp_path}/deep") == ["launched"] or sorted(os.listdir(f"{tmp_path}/deep")) == [".launched.crc", "launched"]


def test_launch_waits_for_every_part(spark, tmp_path):
    wanted = spark.createDataFrame([("p1",), ("p2",)], "part string")
    folder = f"{tmp_path}/audits"

    def run(who):
        scan.launch_once(scan.audits(spark, folder), ["part"], wanted, folder, f"{tmp_path}/marker", f"{tmp_path}/{who}", who)
        return [r["state"] for r in spark.read.parquet(f"{tmp_path}/{who}").orderBy("batch").collect()]

    spark.createDataFrame([("p1", "complete", "2"), ("p2", "missing_source", "2")], scan.AUDIT).write.json(f"{folder}/1")
    assert run("a") == ["waiting"]
    spark.createDataFrame([("p2", "complete", "2")], scan.AUDIT).write.json(f"{folder}/2")
    assert run("a") == ["waiting", "launched"] and run("b")[-1] == "refused" and run("a") == ["waiting", "launched"]


def line(step, loss):
    return f"step {step} loss {loss} lr 6e-4 norm 0.9 seconds 1.2\n"


def test_a_log_that_grows_and_is_rotated(spark, tmp_path):
    source, landing, out = (str(tmp_path / x) for x in ("logs", "landing", "out"))
    os.mkdir(source)
    now, old = f"{source}/run.log", f"{source}/run.log.1"
    at = datetime.datetime(2024, 5, 1, tzinfo=datetime.UTC).timestamp()

    def write(path, mode, text, second):
        with open(path, mode) as f:
            f.write(text)
        os.utime(path, (at + second, at + second))

    def losses(since):
        since = logtail.poll(spark, source, landing, since)
        return since, {(r["step"], r["training"]): r["loss"] for r in logtail.tail(spark, landing, out).collect()}

    write(now, "w", line(1, 5.0) + "noise\n" + line(2, 4.5) + "validation step 1 loss 4.8\n", 0)
    since, got = losses(None)
    assert got == {(1, True): 5.0, (2, True): 4.5, (1, False): 4.8}
    write(now, "a", line(2, 4.4) + line(3, 4.0), 0.5)  # restarted at step 2, within the overlap
    since, got = losses(since)
    assert got == {(1, True): 5.0, (2, True): 4.4, (3, True): 4.0, (1, False): 4.8}
    os.rename(now, old)
    write(now, "w", line(3, 3.9) + "validation step 3 loss 3.8\n", 1)
    since, got = losses(since)
    assert got == {(1, True): 5.0, (2, True): 4.4, (3, True): 3.9, (1, False): 4.8, (3, False): 3.8}
    same, again = losses(since)  # nothing new: what lies within the overlap replaces itself
    assert same == since and again == got
    assert since == datetime.datetime.fromtimestamp(at + 1, datetime.UTC)


def test_metrics_while_the_stream_runs(spark, tmp_path):
    landing, out = f"{tmp_path}/landing", f"{tmp_path}/out"

    def land(name, *texts):
        rows = spark.createDataFrame([(k, t.strip()) for k, t in enumerate(texts)], "no long, line string")
        rows.select(logtail.landed(F.lit(name), F.lit(0), F.col("no"), F.col("line"))).coalesce(1).write.text(f"{landing}/{name}")

    land(1, line(1, 5.0), line(1, 4.9), "validation step 1 loss 4.7")
    running = logtail.serve(spark, landing, out)
    try:
        running.processAllAvailable()
        assert [tuple(r)[:3] for r in logtail.metrics(spark, out).collect()] == [(1, 4.9, 4.7)]
        land(2, line(2, 4.5), "validation step 1 loss 4.6")
        running.processAllAvailable()
        assert sorted(tuple(r)[:3] for r in logtail.metrics(spark, out).collect()) == [(1, 4.9, 4.6), (2, 4.5, None)]
    finally:
        running.stop()
