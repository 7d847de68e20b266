import random

from pyspark.sql import functions as F

from quorumlake.operators import merge
from quorumlake.streaming import watermarks as wm
from quorumlake.streaming.votes import StateFile, fold_stream

SCHEMA = "meeting_id string, agenda_anchor string, seq long, source string, top_label string, result_text string, ja int, nein int, enthaltung int, members array<struct<name:string,vote:string>>, image_url string, image_sha string, file_id string"


def arrivals(seed, n=400):
    rng = random.Random(seed)
    maybe = lambda x: x if rng.random() < 0.6 else None
    rows = []
    for i in range(n):
        members = maybe([(f"n{i}", "ja")]) if rng.random() < 0.8 else []
        rows.append((f"m{rng.randrange(4)}", rng.choice(["top1", "top2", "top3.1", None, ""]), i, rng.choice(["live", "live", "live", "pdf"]), maybe(f"l{i}"), maybe(f"r{i}"), maybe(i), maybe(i), maybe(i), members, maybe(f"u{i}"), maybe(f"s{i}"), maybe(f"f{i}")))
    return rows


def sequential(rows):
    """One arrival after the other, as a store with one row for each key would take them."""
    store = {}
    for r in rows:
        m, a, _, source, label, result, ja, nein, enth, members, url, sha, file = r
        if not a:
            continue
        new = {"source": source, "top_label": label, "image_url": url, "image_sha": sha}
        filled = {"result_text": result, "ja": ja, "nein": nein, "enthaltung": enth, "members": members or None, "file_id": file}
        old = store.get((m, a))
        if old is None:
            store[m, a] = new | filled
        elif not (old["source"] == "pdf" and source != "pdf"):
            store[m, a] = new | {k: old[k] if v is None else v for k, v in filled.items()}
    return store


def stored(df):
    names = ["source", "top_label", "image_url", "image_sha", "result_text", "ja", "nein", "enthaltung", "members", "file_id"]
    return {(r.meeting_id, r.agenda_anchor): {k: [tuple(x) for x in r[k]] if k == "members" and r[k] else r[k] for k in names} for r in df.collect()}


def test_votes_fold_as_a_sequence(spark):
    for seed in range(3):
        rows = arrivals(seed)
        shuffled = random.Random(9).sample(rows, len(rows))
        assert stored(merge.merge_votes(spark.createDataFrame(shuffled, SCHEMA))) == sequential(rows)


def test_stream_equals_batch(spark, tmp_path):
    rows = arrivals(7, 120)
    late = random.Random(1).sample(rows, len(rows))
    landing = str(tmp_path / "landing")
    for i in range(3):
        spark.createDataFrame(late[i::3], SCHEMA).coalesce(1).write.mode("append").parquet(landing)
    schema = spark.read.parquet(landing).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
    out = [str(tmp_path / x) for x in ("bronze", "silver", "state")]
    keys = ["meeting_id", "agenda_anchor"]
    for _ in range(2):  # the second run finds nothing new
        q = fold_stream(stream.where("agenda_anchor <> ''"), out[0], out[1], keys, merge.merge_votes, out[2], buckets=4)
        q.awaitTermination(120)
        assert q.exception() is None
    assert stored(spark.read.parquet(out[1])) == sequential(rows)
    assert spark.read.parquet(out[0]).select("batch").distinct().count() == 3


def test_retry_and_versions(spark):
    e = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 4, False), ("b", 5, False), ("b", 6, False), ("c", 7, True)], "f string, seq int, ok boolean")
    assert {r.f: (r.attempts, r.exhausted) for r in merge.retry_budget(e, ["f"], "seq", "ok").collect()} == {"a": (1, False), "b": (3, True)}
    v = spark.createDataFrame([("f", i, s) for i, s in enumerate("aabac")], "f string, seq int, sha string")
    assert sorted((r.sha, r.seq, r.superseded_at) for r in merge.version_history(v, ["f"], "seq", "sha").collect()) == [("a", 0, 2), ("b", 2, 3)]


def test_override(spark):
    rows = spark.createDataFrame([("1", "x", True), ("1", "y", False), ("2", "z", True)], "file_id string, vorlage string, own boolean")
    got = merge.override_own(rows, spark.createDataFrame([("1", "y"), ("3", "w")], "file_id string, vorlage string"), "file_id", "vorlage")
    assert sorted(map(tuple, got.collect())) == [("1", "x", False), ("1", "y", True), ("2", "z", True), ("3", "w", True)]


def test_watermark(spark):
    at = lambda t: F.lit(t).cast("timestamp_ntz")

    def after(rows):
        df = spark.createDataFrame(rows, "m string, bad boolean").select(F.col("m").cast("timestamp_ntz").alias("m"), "bad")
        return str(wm.next_watermark(df, "m", F.col("bad"), at("2026-07-10 00:00:00"), at("2026-07-01 00:00:00")).first()["watermark"])

    assert after([("2026-07-05", False)]) == "2026-07-09 00:00:00"
    assert after([("2026-07-05", True), ("2026-07-03", True), ("2026-07-02", False)]) == "2026-07-03 00:00:00"
    assert after([(None, True), ("2026-07-05", False)]) == "2026-07-01 00:00:00"


def test_state_file(spark, tmp_path):
    state = StateFile(spark, f"file://{tmp_path}/meta")
    assert state.get("since") is None
    state.set("since", {"at": "2026-07-10"})
    state.set("since", {"at": "2026-07-11"})
    assert state.get("since") == {"at": "2026-07-11"}
