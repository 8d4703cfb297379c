"""Materialised samples against a plain replay of the events; sources and small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import evals, runs
from colloquy.sources import corpora, files

MESSAGE = "sample_id string, seq long, message_id string, role string, content string, source_stage string, turn_index long"


def events(seed):
    rng = random.Random(seed)
    ids = [f"s{k}" for k in range(6)]
    inputs = [(s, n, f"{s}-in{n}", "user" if n else "system", f"in {n}", "seed", None) for s in ids for n in range(2)]
    inferences, appended = [], []
    for seq in range(40):
        payload = {}
        if rng.random() < 0.7:
            payload["status"] = rng.choice(["success", "failed"])
        if rng.random() < 0.6:
            payload["assistant_completion"] = rng.choice([f"reply {seq}", None])
        if rng.random() < 0.3:
            payload["assistant_full"] = rng.choice([f"full {seq}", None])
        if rng.random() < 0.3:
            payload["assistant_prefill"] = f"pre{seq} "
        if rng.random() < 0.2:
            payload["assistant_message_id"] = rng.choice(["m1", "m2"])
        inferences.append((rng.choice([*ids, "unknown"]), seq, json.dumps(payload)))
    for seq in range(20):
        s = rng.choice([*ids, "unknown"])
        appended.append((s, seq, f"{s}-a{rng.randint(0, 2)}", rng.choice(["user", "assistant"]), f"said {seq}", "rollout_assistant", rng.randint(0, 3)))
    return inputs, inferences, appended


def replay(inputs, inferences, appended):
    """Messages of each sample as (message_id, content) in order, by going through the events one by one."""
    samples = {}
    for s, _, mid, role, content, stage, turn in inputs:
        samples.setdefault(s, {"m": [], "state": {}})["m"].append([mid, role, content, stage, turn])

    def upsert(sample, message):
        for k, m in enumerate(sample["m"]):
            if m[0] == message[0]:
                sample["m"][k] = message
                return
        sample["m"].append(message)

    for s, _, payload in inferences:
        if s not in samples:
            continue
        state = samples[s]["state"]
        state.update(json.loads(payload))
        if state.get("status") == "success" and state.get("assistant_completion") is not None:
            full = state.get("assistant_full")
            if full is None:
                full = (state.get("assistant_prefill") or "") + state["assistant_completion"]
            mid = state.get("assistant_message_id") or f"{s}:assistant"
            upsert(samples[s], [mid, "assistant", full, None, None])
            state["assistant_full"] = full
    for s, _, mid, role, content, stage, turn in appended:
        if s in samples:
            upsert(samples[s], [mid, role, content, stage, turn])
    out = {}
    for s, x in samples.items():
        key = lambda e: (e[1][4] if e[1][4] is not None else e[0], 0 if e[1][3] == "seed" else 1 if e[1][1] == "assistant" else 2, e[0])
        out[s] = [(m[0], m[2]) for _, m in sorted(enumerate(x["m"]), key=key)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_materialized_samples(spark, seed):
    inputs, inferences, appended = events(seed)
    overlays = [("s0", "v", "o1", "failed", 1, "m1", "x", 0), ("s0", "v", "o1", "success", 1, "m1", "y", 1), ("s1", "v", "o2", "failed", 1, "m1", "z", 0), ("unknown", "v", "o3", "success", 1, "m1", "z", 0)]
    notes = [("s0", "k", "a1", "{1}", 0), ("s0", "k", "a1", "{2}", 1), ("s0", "k", "a2", "{3}", 2)]
    out = runs.materialize(
        spark.createDataFrame(inputs, MESSAGE), spark.createDataFrame(inferences, "sample_id string, seq long, payload string"), spark.createDataFrame(appended, MESSAGE),
        spark.createDataFrame(overlays, "sample_id string, variant string, overlay_id string, status string, attempt int, target string, edited string, seq long"),
        spark.createDataFrame(notes, "sample_id string, metrics_key string, annotation_id string, metrics string, seq long"),
    )
    rows = {r.sample_id: r for r in out.collect()}
    assert {s: [(m.message_id, m.content) for m in r.messages] for s, r in rows.items()} == replay(inputs, inferences, appended)
    assert [(v.variant, v.status, [o.edited for o in v.overlays]) for v in rows["s0"].edit_variants] == [("v", "success", ["y"])] and rows["s1"].edit_variants[0].status == "failed"
    assert [(m.annotation_id, m.metrics) for m in rows["s0"].metrics] == [("a1", "{2}"), ("a2", "{3}")] and rows["s2"].metrics is None


def test_candidates_that_are_not_ready(spark):
    messages = spark.createDataFrame([(1, "user", "q"), (1, "assistant", "r"), (2, "user", "q"), (3, "user", "a"), (3, "user", "b")], "sample_id int, role string, content string")
    inference = spark.createDataFrame([(1, "success", "r"), (2, "failed", None), (3, "success", "r")], "sample_id int, status string, assistant_completion string")
    edits = spark.createDataFrame([(1, "v", 1, "success", 1, "low"), (1, "v", 2, "success", 2, "high"), (1, "w", 3, "success", 9, "other")], "sample_id int, variant string, overlay_id int, status string, attempt int, edited string")
    single = messages.where("sample_id < 3")
    assert [tuple(r) for r in runs.training_candidates(single, inference, edits, "v", True).collect()] == [(1, "q", "r", "high")]
    with pytest.raises(Exception, match="not ready"):
        runs.training_candidates(single, inference, edits, "v").collect()
    with pytest.raises(Exception, match="more than one turn"):
        runs.training_candidates(messages, inference, edits, "v", True).collect()


def test_fingerprints_of_sets_and_settings(spark):
    a = spark.range(50).select(F.col("id").cast("string").alias("sample_id"))
    assert runs.dataset_fingerprint(a, "sample_id") == runs.dataset_fingerprint(a.repartition(7), "sample_id") == runs.check_fingerprint(a, a)
    with pytest.raises(ValueError, match="missing .'7'., new .'x'."):
        runs.check_fingerprint(a, a.where("sample_id <> '7'").union(spark.createDataFrame([("x",)], "sample_id string")))
    stages = {}
    assert runs.register_stage(stages, "s", {"a": 1, "b": 2}) == runs.register_stage(stages, "s", {"b": 2, "a": 1})
    with pytest.raises(ValueError, match="changed_keys.*'a'"):
        runs.register_stage(stages, "s", {"a": 3, "b": 2, "c": 1})
    assert runs.payload_difference(None, {}) == {"change": "no_previous_payload"} and len(runs.config_fingerprint({"a": 1})) == 10
    assert evals.default_deviations({"a": 1}, {"a": 1, "b": 2}) == [("b", 2, "<missing>")]
    assert evals.scale_grid(False)[:3] == [-4.0, -3.0, -2.0] and len(evals.scale_grid(True)) == 24 and 0.0 not in evals.scale_grid(True)


def test_a_rollout_without_messages(spark):
    rows = spark.createDataFrame([(1, 0, 0, "system", "s", "seed")], "seed_id int, response_index int, message_order int, role string, content string, source_stage string")
    with pytest.raises(Exception, match="without messages"):
        runs.rollouts_by_seed(rows).collect()


def test_evaluators_that_are_known(spark):
    known = spark.createDataFrame([(1, "0", 0, "a", "score", 1.0)], "seed_id int, rollout string, position int, evaluator string, key string, value double")
    assert runs.missing_evaluators(known, ["a", "b"]) == ["b"]


def test_poisson_interval_covers_the_mean(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 2).alias("g"), ((F.col("id") * 37) % 101).cast("double").alias("v"))
    one = sorted(map(tuple, evals.poisson_interval(rows.repartition(3), ["g"], "v", "id", draws=60).collect()))
    assert one == sorted(map(tuple, evals.poisson_interval(rows.repartition(5), ["g"], "v", "id", draws=60).collect()))
    assert all(low < mean < high and high - low < 6 for _, mean, low, high in one)


def test_corpora(spark):
    chat = json.dumps([{"role": "user", "content": "hi"}, {"role": "assistant", "content": None, "tool_calls": [{"f": 1}]}, {"role": "assistant", "content": ["a", 1]}, {"role": "user", "content": " \n"}])
    df = spark.createDataFrame([("c1", "m", "en", 2, chat), ("c2", "m", "de", 2, chat), ("c3", "x", "en", 2, chat), ("c4", "m", "en", 1, chat), ("c5", "m", "en", 2, "[]")], "conversation_id string, model string, language string, turn int, conversation string")
    got = corpora.adapter("chats")(df, models=["m"], languages=["en"], min_turn=2, min_assistant_turns=2).collect()
    assert [(r.sample_id, [(m.role, json.loads(m.content) if m.role == "assistant" else m.content) for m in r.messages]) for r in got] == [("chats::c1", [("user", "hi"), ("assistant", [{"f": 1}]), ("assistant", ["a", 1])])]
    turn = "array<struct<role:string,content:string,if_chosen:boolean,model_provider:string,model_name:string>>"
    history = [("user", "q", None, None, None), ("model", "no", False, "p", "A"), ("model", "yes", True, "p", "Big-B")]
    d = spark.createDataFrame([(1, history), (2, [("user", "q", None, None, None)])], f"conversation_id int, conversation_history {turn}")
    assert [(r.sample_id, r.assistant_model, [m.content for m in r.messages]) for r in corpora.adapter("dialogues")(d, models=["big"]).collect()] == [("dialogues::1", "p/Big-B", ["q", "yes"])]
    assert corpora.adapter("dialogues")(d).count() == 2 and corpora.adapter("dialogues")(d, models=["other"]).count() == 0
    tr = spark.createDataFrame([(1, chat, "r", 1), (2, chat, "r", 0)], "trajectory_id int, trajectory string, repo string, resolved int")
    assert corpora.adapter("trajectories")(tr, resolved_only=True).count() == 1
    with pytest.raises(KeyError):
        corpora.adapter("none")
    p = corpora.prompts(spark.createDataFrame([("a", None), ("", "x"), ("b", "y")], "t string, c string"), F.col("t"), F.col("c"), "harmful")
    assert sorted((r.prompt, r.category) for r in p.collect()) == [("a", "unknown"), ("b", "y")]
    q = spark.createDataFrame([("do", " "), ("do", "it")], "a string, b string").select(corpora.instruction(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in q] == ["do", "do\n\nit"]


def test_run_logs_and_sources(spark, tmp_path):
    for place, status in (("m1/e1", "ok"), ("m1/e2/run_01", "ok"), ("m2/e1/run_00", "failed")):
        (tmp_path / "r" / place).mkdir(parents=True)
        (tmp_path / "r" / place / "run_info.json").write_text(json.dumps({"status": status, "log": "x"}))
    assert sorted(tuple(r)[:3] for r in corpora.run_logs(spark, str(tmp_path / "r"), "log string").collect()) == [("m1", "e1", "run_00"), ("m1", "e2", "run_01")]
    spark.range(30).withColumnRenamed("id", "sample_id").write.json(str(tmp_path / "j"))
    ids = lambda seed: [r.sample_id for r in corpora.load_source(spark, "json", str(tmp_path / "j"), seed, 10).collect()]
    assert ids(1) == ids(1) != ids(2) and len(ids(1)) == 10
    rows, broken = files.read_tolerant(spark, str(tmp_path / "absent.jsonl"), "a int")
    assert rows.count() == broken.count() == 0


def test_reference_sets_and_forms(spark):
    items = spark.createDataFrame([(1,), (2,)], "id int")
    ratings = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (2, "a", 2)], "id int, rater string, score int")
    assert sorted(map(tuple, evals.reference_set(ratings, items).collect())) == [(1, 2.0, 2), (2, 2.0, 1)]
    with pytest.raises(Exception, match="incomplete"):
        evals.reference_set(ratings, items, complete=True).collect()
    with pytest.raises(Exception, match="a rater twice"):
        evals.reference_set(ratings.union(ratings), items).collect()
    with pytest.raises(ValueError):
        evals.form_responses(["q"], spark.createDataFrame([("x", "yes")], "rater string, consent string"))
    with pytest.raises(ValueError):
        evals.fits_context(F.lit(1), 10, 100, 60)
    with pytest.raises(ValueError):
        evals.sample_scores(items, "other")


def test_scores_are_dealt_by_their_number(spark, monkeypatch):
    """More scores go to more tasks, whatever the session's number of partitions, and to the same rows."""
    monkeypatch.setattr(runs, "DEALT_ROWS", 50)
    known = spark.range(1000).select(F.col("id").alias("seed_id"), F.lit("1").alias("rollout"), F.lit(0).alias("position"), F.lit("A").alias("evaluator"), F.lit("k").alias("key"), F.lit(1.0).alias("value"))
    new = known.where("seed_id % 4 = 0").withColumn("value", F.lit(2.0))
    dealt = runs.upsert_scores(known, new, {"A": "X"}, rows=1250)
    assert dealt.rdd.getNumPartitions() == 25
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, runs.upsert_scores(known, new, {"A": "X"}).collect()))
    assert dealt.count() == 1250 and runs.upsert_scores(known, new, rows=1250).where("value = 2").count() == 250
