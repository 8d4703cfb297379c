"""Scans of nested evaluation logs in their folders, against what each hand-made log must give."""

import copy
import json
import math
from pathlib import Path

import pytest

from colloquy.operators import evals
from colloquy.plans import evals as plans
from colloquy.sources import eval_logs
from pyspark.sql import functions as F


def log(samples, metrics=None, scored=3, unscored=1, status="success"):
    return {"status": status, "results": {"scores": [{"scored_samples": scored, "unscored_samples": unscored, "metrics": metrics or {}}]} if status == "success" else {"scores": []}, "samples": samples}


def sample(score, before=(), after=(), **rest):
    return {**rest, "events": [*before, {"event": "score", "score": score}, *after]}


AB = {"A": 1.0, "B": 0.0}
TRAITS = log(
    [
        sample({"value": "C", "answer": "A"}, [{"event": "model", "score": "none"}], metadata={"trait": "Openness", "answer_mapping": AB}),
        sample({"value": "C", "answer": "B"}, after=[{"event": "score", "score": {"value": "C", "answer": "A"}}], metadata={"trait": "Openness", "answer_mapping": AB}),
        sample({"value": "C", "answer": "B"}, metadata={"trait": "Calm", "answer_mapping": {"A": 0, "B": 1}}),
        sample({"value": "I", "answer": None}, metadata={"trait": "Calm", "answer_mapping": AB}),
        sample({"value": "C", "answer": "E"}, metadata={"trait": "Calm", "answer_mapping": AB}),
        sample({"value": "C", "answer": "A"}, metadata={"trait": "", "answer_mapping": AB}),
        sample({"value": "C", "answer": "A"}, metadata={"trait": "Calm"}),
        {"metadata": {"trait": "Calm", "answer_mapping": AB}, "events": [{"event": "model"}]},
        {"metadata": None},
    ],
    {"Openness": {"value": 0.75}, "Calm": {"value": 0.25}, "other": "text", "empty": {}},
)
RIGHT = log(
    [
        sample({"value": "C", "answer": "A"}, target="A", metadata={}), sample({"value": "I", "answer": "C"}, target="B"), sample({"value": "I", "answer": None, "explanation": "ANSWER: D"}, target="D"),
        sample({"value": "I", "answer": "", "explanation": "no idea"}, target="D"), sample({"value": "N", "answer": "A"}, target="A"), sample({"value": "I", "answer": None, "explanation": "ANSWER: D"}, target=["D"]),
    ],
    {"accuracy": {"value": 0.5}}, 3, 0,
)
SHARES = log(
    [
        sample({"value": 0.6, "metadata": {"choice_mass": 0.9, "num_choices": 5}}, metadata={"trait": "Openness"}), sample({"value": 0.5, "metadata": {"logprobs": {"A": math.log(0.4), "B": math.log(0.3)}}}, metadata={"trait": "Openness"}),
        sample({"value": float("nan"), "metadata": {"choice_mass": 0.2}}, metadata={"trait": "Calm"}), sample({"value": "0.5", "metadata": {"choice_mass": 0.1}}, metadata={"trait": "Calm"}),
        sample({"value": 1, "metadata": None}, metadata={"trait": "Calm"}), sample({"value": 0.25, "metadata": {"choice_mass": None, "logprobs": {}}}, metadata={}),
    ],
    {"Openness": {"value": 0.55}}, 0, 0,
)
FAILED = log([], status="error")


def put(folder, content, scale=None, run=None, status="ok", name="log.json", recorded=None):
    base = folder / run if run else folder
    (base / "native" / "inspect_logs").mkdir(parents=True, exist_ok=True)
    path = base / "native" / "inspect_logs" / name
    path.write_text(json.dumps(content, indent=1))
    (base / "run_info.json").write_text(json.dumps({"status": status, "scale": scale, "native": {"inspect_log_path": str(path) if recorded is None else recorded}}))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("a run +")
    put(root / "base" / "trait", TRAITS)
    put(root / "lora_+1x" / "trait", TRAITS, 1.0)
    put(root / "base" / "mmlu", RIGHT)
    put(root / "lora_-1p50x" / "mmlu", RIGHT, run="run_02")
    put(root / "lora_-1p50x" / "mmlu", FAILED, run="run_03")
    put(root / "odd name" / "mmlu", RIGHT, run="run_01")
    put(root / "base" / "trait_logprobs", SHARES, run="run_01", recorded="/gone/elsewhere.json")
    put(root / "base" / "trait_logprobs", RIGHT, run="run_01", name="a.json", recorded="/gone/elsewhere.json")
    put(root / "base" / "mmlu_logprobs", SHARES, run="run_07", name="b.json")
    put(root / "base" / "mmlu_logprobs", RIGHT, run="run_07", name="c.json", recorded=str(root / "base" / "mmlu_logprobs" / "run_07" / "native" / "inspect_logs" / "b.json"))
    put(root / "base" / "bfi", TRAITS, run="run_01")
    put(root / "base" / "bfi", RIGHT)  # beside a run folder: the eval's only run
    put(root / "figures" / "mmlu", RIGHT)
    put(root / "base" / "broken", RIGHT, status="failed")
    put(root / "base" / "nowhere", RIGHT, recorded="")
    return root


def by_run(df, *values):
    return {(r.model, r.eval, r.run): tuple(r[v] for v in values) for r in df.collect()}


def test_runs_and_their_logs(spark, root):
    found = eval_logs.logs(spark, str(root))
    assert by_run(found, "scale", "status") == {
        ("base", "trait", "run_00"): (0.0, "success"), ("lora_+1x", "trait", "run_00"): (1.0, "success"), ("base", "mmlu", "run_00"): (0.0, "success"), ("lora_-1p50x", "mmlu", "run_02"): (-1.5, "success"),
        ("lora_-1p50x", "mmlu", "run_03"): (-1.5, "error"), ("base", "trait_logprobs", "run_01"): (0.0, "success"), ("base", "mmlu_logprobs", "run_07"): (0.0, "success"), ("base", "bfi", "run_00"): (0.0, "success"),
    }
    files = {k: v[0].rsplit("/", 1)[-1] for k, v in by_run(found, "file").items()}
    assert files["base", "trait_logprobs", "run_01"] == "log.json" and files["base", "mmlu_logprobs", "run_07"] == "b.json"
    few = eval_logs.logs(spark, str(root), models=["base"], evals=["mmlu", "trait"])
    assert set(by_run(few, "scale")) == {("base", "mmlu", "run_00"), ("base", "trait", "run_00")}
    assert eval_logs.logs(spark, str(root / "none")).collect() == [] and eval_logs.samples(eval_logs.logs(spark, str(root / "none"))).collect() == []


def test_reported_metrics(spark, root):
    got = {(r.model, r.eval, r.metric): (r.value, r.parse_rate) for r in eval_logs.reported(eval_logs.logs(spark, str(root), evals=["trait", "mmlu", "trait_logprobs"])).collect()}
    assert got["base", "trait", "Openness"] == (0.75, 0.75) and got["base", "mmlu", "accuracy"] == (0.5, 1.0) and got["base", "trait_logprobs", "Openness"] == (0.55, 1.0)
    assert ("base", "trait", "other") not in got and ("base", "trait", "empty") not in got


def scores(spark, found):
    own = eval_logs.samples(found).withColumn("convention", eval_logs.convention(F.col("eval")))
    out = {}
    for r in evals.convention_scores(own, ["model", "eval"]).collect():
        out.setdefault((r.model, r.eval, r.grp, r.name), []).append(round(r.value, 9))
    return {k: sorted(v) for k, v in out.items()}, {(r.model, r.eval): (r.n, round(r.choice_mass, 9)) for r in evals.pooled_mass(own, ["model", "eval"]).collect()}


def test_scores_of_four_conventions(spark, root):
    got, mass = scores(spark, eval_logs.logs(spark, str(root), models=["base"], evals=["trait", "mmlu", "trait_logprobs", "mmlu_logprobs"]))
    own = lambda e, g: {n: v for (_, ev, gr, n), v in got.items() if (ev, gr) == (e, g)}
    assert own("trait", "Openness") == {"score": [0.0, 1.0]} and own("trait", "Calm") == {"score": [1.0]}
    assert own("mmlu", "accuracy") == {"score": [0.0, 0.0, 0.0, 0.0, 1.0], "parsed": [0.0, 0.0, 0.0, 1.0, 1.0], "recovered": [0.0, 0.0, 0.0, 1.0, 1.0]}
    assert own("trait_logprobs", "Openness") == {"score": [0.5, 0.6], "mass": [0.7, 0.9], "num_choices": [4.0, 5.0]} and own("trait_logprobs", "Calm") == {"score": [1.0], "mass": [1.0], "num_choices": [4.0]}
    assert own("mmlu_logprobs", "accuracy")["score"] == [0.25, 0.5, 0.6, 1.0]
    assert mass == {("base", "trait_logprobs"): (3, 0.6), ("base", "mmlu_logprobs"): (3, 0.6)}


def test_bare_folders(spark, root, tmp_path):
    for model in ("lora_2x", "unnamed"):
        put(tmp_path / "x" / model / "mmlu", RIGHT)
        (tmp_path / "x" / model / "mmlu" / "run_info.json").unlink()
    found = eval_logs.bare_logs(spark, str(tmp_path), "mmlu")
    assert by_run(found, "scale") == {("lora_2x", "mmlu", "run_1"): (2.0,), ("unnamed", "mmlu", "run_1"): (None,)}
    assert scores(spark, found)[0]["lora_2x", "mmlu", "accuracy", "score"] == [0.0, 0.0, 0.0, 0.0, 1.0]


def test_outputs_are_read_again(spark, tmp_path):
    said = lambda content: {"choices": [{"message": {"content": content}}]}
    meta = {"trait": "T", "answer_mapping": {"A": 1, "B": 2, "C": 4}, "reverse": False}
    rows = [
        {"metadata": meta, "output": said("ANSWER: B")}, {"metadata": meta, "output": said([{"type": "text", "text": "ANSWER:"}, {"text": "C"}, "x"]), "scores": {"any_choice": {"answer": None}}},
        {"metadata": {**meta, "reverse": True}, "output": said("ANSWER: B"), "scores": {"any_choice": {"answer": " A "}}}, {"metadata": meta, "output": said("no idea")}, {"metadata": meta, "output": {"choices": []}},
        {"metadata": meta, "output": said("ANSWER: D")}, {"metadata": {}, "output": said("ANSWER: B")},
    ]
    logprobs = copy.deepcopy(rows)
    for r in logprobs[:3]:
        r["events"] = [{"event": "score", "score": {"value": 1, "metadata": {"logprobs": {"A": math.log(0.5), "C": math.log(0.25), "E": math.log(0.05)}}}}]
    put(tmp_path / "base" / "trait", log(rows))
    put(tmp_path / "lora_1x" / "trait", log(logprobs))
    own = eval_logs.samples(eval_logs.logs(spark, str(tmp_path)))
    assert {r.output for r in own.collect()} == {"ANSWER: B", "ANSWER: C", "no idea", "", "ANSWER: D"}
    assert [(round(r.score, 9), r.n_parsed, r.n_total) for r in evals.reparsed_scores(own.where("model = 'base'"), ["model"]).collect()] == [(round((0.5 + 1 + 1) / 3, 9), 3, 6)]
    for kind, total in (("raw", 1.0), ("softmax", 0.8)):
        r = evals.logprob_rescored(own.where("model = 'lora_1x'"), ["model"], kind).collect()[0]
        straight, turned = (0.5 * 1 + 0.25 * 4) / 4 / total, (0.5 * 4 + 0.25 * 1) / 4 / total
        assert math.isclose(r.score, (2 * straight + turned) / 3) and (r.n_parsed, r.n_total) == (3, 6)


def test_order_of_a_sweep(spark):
    rows = [("b", 1.0, "run_01"), ("a", -1.5, "run_02"), ("a", 1.0, "run_00"), ("c", -1.5, "run_01")]
    assert [tuple(r) for r in evals.sweep_order(spark.createDataFrame(rows, "model string, scale double, run string")).collect()] == sorted(rows, key=lambda r: (r[1], r[2]))


def test_logs_take_less_room_than_their_columns(spark):
    """Files of logs are compressed, and their text is made after the shuffle: neither grows by the length of a sample's JSON."""
    folder = "/root/testdata/sf0.001"
    path = plans.written_logs(spark, folder)
    files = list(Path(path.removeprefix("file:")).rglob("part-*"))
    rows = eval_logs.samples(eval_logs.partitioned_logs(spark, path)).count()
    assert files and all(f.name.endswith(".txt.gz") for f in files) and sum(f.stat().st_size for f in files) < 60 * rows
    assert rows == spark.read.parquet(f"{folder}/lineitem.parquet").count()
    # every kind of sample is JSON, whatever the row has
    row = F.struct(*(F.col(c) for c in ("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_linestatus")))
    odd = spark.sql("select id as l_orderkey, cast(id % 7 + 1 as int) as l_linenumber, if(id % 2 = 0, null, 0.05D) as l_discount, if(id % 3 = 0, null, 0.02D) as l_tax, if(id % 5 = 0, null, 'A') as l_returnflag, 'O' as l_linestatus from range(400)")
    texts = odd.select(row.alias("r")).select(plans.sample_text(F.col("r"), F.lit("mmlu_logprobs")).alias("a"), plans.sample_text(F.col("r"), F.lit("trait")).alias("b")).collect()
    made = [json.loads(t) for r in texts for t in r]
    assert len(made) == 800 and all(len(m["events"]) == 3 and m["target"] == "B" for m in made)
