"""Cases whose answers are known by hand or from a plain version."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import logprobs as lp
from colloquy.functions import metrics, stats, text
from colloquy.operators import experiments, factors, generated, judging, messages
from colloquy.plans import conversations
from colloquy.sources import files
from colloquy.streaming import log


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_wilson(spark):
    p, low, high = stats.wilson(F.lit(6), F.lit(10))
    zero = stats.wilson(F.lit(0), F.lit(0))
    row = spark.range(1).select(p, low, high, *zero).first()
    assert np.allclose(row, (0.6, 0.312674, 0.831820, 0, 0, 0), atol=1e-6)


def test_intervals():
    assert stats.Interval.parse("ci95_from_bootstrap_500") == stats.Interval("bootstrap", 0.95, 500)
    for bad in ("ci", "ci0.95_from_std", "ci95_from_bootstrap", "mean"):
        with pytest.raises(ValueError):
            stats.Interval.parse(bad)
    assert abs(stats.student_t(0.975, 10) - 2.228139) < 1e-3 and abs(stats.f_quantile(0.95, 3, 20) - 3.098391) < 1e-2
    assert stats.bca(np.array([1.0])) == (0.0, 0.0) and stats.bca(np.array([2.0, 2.0])) == (2.0, 2.0)
    low, high = stats.bca(np.random.default_rng(0).normal(size=400))
    assert -0.2 < low < 0 < high < 0.2 or low < high


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = spark.range(300).select((F.col("id") % 2).alias("g"), (F.col("id") % 7).cast("double").alias("v"))
    one = values(stats.bootstrap_by_group(rows.repartition(1), ["g"], "v", draws=200))
    assert one == values(stats.bootstrap_by_group(rows.repartition(7), ["g"], "v", draws=200))
    assert all(low < mean < high for _, _, mean, low, high in one)


@pytest.mark.parametrize(("said", "letter"), [("ANSWER: b", "B"), ("C) since", "C"), ("D\nbecause", "D"), ("the correct answer is A", "A"), ("ANSWER: E", None), ("ANSWER: E. The answer is B", "B"), ("", None), (None, None), ("Apple", None), ("\n\tB) because", "B"), ("ANSWER: E ANSWER: B", None)])
def test_answers(spark, said, letter):
    assert spark.createDataFrame([(said,)], "t string").select(text.parse_answer(F.col("t"), "ABCD")).first()[0] == letter


@pytest.mark.parametrize(("said", "rating"), [("3", 3), ("**4** - yes", 4), ("I would rate this a 2", 2), ("maybe 5 or so", 5), ("10", None), ("", None), ("Of 5 options I rate it\n3", 5)])
def test_ratings(spark, said, rating):
    assert spark.createDataFrame([(said,)], "t string").select(text.parse_rating(F.col("t"))).first()[0] == rating


@pytest.mark.parametrize(("said", "want"), [
    ('```json\n{"score": 3, "reasoning": "x"}\n```', (3, "x", True)), ('{"score": 99, "reasoning": "r", "evidence": "e"}', (4, "e] r", True)), ("score: -2 because", (-2, "Parse error", False)), ("nothing", (0, "Parse error", False)),
    ('{"score": 2.5}', (2, "", True)), ('{"score": -2.5}', (-2, "", True)), ('{"score": "3"}', (3, "", True)), ('{"score": "2.5"}', (0, "Parse error", False)), ("score = 3", (0, "Parse error", False)), ('{"other": 1}', (0, "", True)),
    ('"score": 2, "reasoning": "cut off" and', (2, "cut off", True)),
])
def test_judge_replies(spark, said, want):
    assert tuple(spark.createDataFrame([(said,)], "t string").select(*text.judge_reply(F.col("t"), -4, 4, 0)).first()) == want


@pytest.mark.parametrize(("said", "letter"), [("A", "A"), ("b)", "B"), ("C\nx", "C"), ("So it is A", None), ("B) is the correct answer", "B"), ("I say B) is the correct answer", None), ("the answer is: d", "D"), ("E", None)])
def test_choices(spark, said, letter):
    assert spark.createDataFrame([(said,)], "t string").select(text.parse_choice(F.col("t"))).first()[0] == letter


@pytest.mark.parametrize(("said", "letter"), [("**b** because", "B"), ("I choose A over B", "A"), ("neither", None), ("", None)])
def test_options(spark, said, letter):
    assert spark.createDataFrame([(said,)], "t string").select(text.parse_option(F.col("t"))).first()[0] == letter


@pytest.mark.parametrize(("said", "inner", "fixed"), [
    ('sure: {"a": {"b": 1}} ok', '{"a": {"b": 1}}', None), ('```\n{"a": 1}\n```', '{"a": 1}', None), ('{"a": [1, 2', None, '{"a": [1, 2]}'), ('{"a": [1, 2}', None, '{"a": [1, 2]}'), ('[{"a": "}]"]', None, '[{"a": "}]"}]'), ("none", None, None),
])
def test_noisy_json(spark, said, inner, fixed):
    row = spark.createDataFrame([(said,)], "t string").select(text.json_object(F.col("t")), text.repaired_json(F.col("t"))).first()
    assert row[0] == inner and row[1] == fixed


def test_words_are_quoted(spark):
    assert spark.createDataFrame([("a.b axb A.B",)], "t string").select(text.count_word(F.col("t"), "a.b")).first()[0] == 2


def test_nested_keys(spark):
    flat = F.create_map(*(F.lit(x) for x in ("a.score", 1.0, "a.b.c", 2.0, "length", 3.0)))
    assert spark.range(1).select(text.nested_keys(flat)).first()[0] == {"a": {"score": 1.0, "b.c": 2.0}, "length": {"score": 3.0}}


def test_wilson_of_values(spark):
    rows = spark.createDataFrame([(1.0,), (0.0,), (None,)], "x double")
    assert rows.agg(stats.wilson_of(F.col("x"))[0]).first()[0] == 0.5
    with pytest.raises(Exception, match="not 0 or 1"):
        spark.createDataFrame([(1.0,), (0.3,)], "x double").agg(stats.wilson_of(F.col("x"))[0]).collect()


def test_residuals_of_rows_without_a_group(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 4.0), (None, 5.0)], "g int, x double")
    assert values(factors.residuals(rows, ["g"], "x").select("x")) == [(-1.0,), (0.0,), (1.0,)]


def test_icc_needs_groups_and_has_an_interval(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(g, float(g + rng.normal())) for g in range(12) for _ in range(4)], "g int, x double")
    r = factors.icc(rows, "g", "x").first()
    assert 0.5 < r.low < r.icc1 < r.high < 1
    assert factors.icc(rows.where("g < 4"), "g", "x").first().icc1 is None


def test_first_match_and_summed_mass_differ(spark):
    top = F.array(*(F.struct(F.lit(t).alias("token"), F.lit(v).alias("logprob")) for t, v in (("A", -1.0), ("▁A", -2.0), ("b", -1.5), ("x", -0.1))))
    first, total = spark.range(1).select(lp.choice_logprobs(top), lp.choice_probs(top)).first()
    assert first == {"A": -1.0, "B": -1.5}
    assert np.isclose(total["A"], np.exp(-1) + np.exp(-2)) and np.isclose(total["B"], np.exp(-1.5))


def test_negative_turns_count_from_the_last_that_is_no_seed(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", "x", "rollout_assistant" if t % 2 else "rollout_user_simulator") for t in range(5)] + [(1, 9, "system", "s", "seed"), (1, None, "user", "x", None)]
    df = spark.createDataFrame(rows, "sample_id long, turn_index long, role string, content string, source_stage string")
    assert values(messages.select_messages(df, turns=(-2, -1)).select("turn_index")) == [(3,), (4,)]
    assert messages.select_messages(df, roles=["system"]).count() == 1


def test_pairs(spark):
    side = "prompt string, response string, seq long"
    amp = spark.createDataFrame([("p", "a1", 1), ("p", "a2", 2), ("q", None, 3), ("q", "a3", 4), (None, "x", 5)], side)
    sup = spark.createDataFrame([("p", "s1", 1), ("q", "s2", 2), ("r", "s3", 3), ("p", None, 4)], side)
    assert values(experiments.preference_pairs(amp, sup)) == [("p", "a1", "s1")]
    assert values(experiments.preference_pairs(amp, sup, "all", "sup")) == [("p", "s1", "a1"), ("p", "s1", "a2"), ("q", "s2", "a3")]
    assert values(experiments.unmatched(amp, sup).select("seq")) == [(3,), (4,)]
    with pytest.raises(ValueError):
        experiments.preference_pairs(amp, sup, "some")


def test_shallow_merge(spark):
    rows = [(1, '{"a": 1, "b": "x"}', 1), (1, '{"a": 2}', 2), (1, '{"b": null}', 3), (2, "{}", 4)]
    out = experiments.shallow_merge(spark.createDataFrame(rows, "id long, props string, seq long"), "id", {"a": "bigint", "b": "string"})
    assert values(out) == [(1, 2, None, 3), (2, None, None, 1)]


def test_queue_asks_again_after_failed_calls_only(spark):
    replies = spark.createDataFrame([(1, "j", "call_error", 1), (2, "j", "call_error", 1), (2, "j", "parse_error", 2)], "response_id long, rater string, status string, seq long")
    expected = spark.createDataFrame([(i, "j") for i in (1, 2, 3)], "response_id long, rater string")
    assert values(judging.queue(expected, replies, True)) == [(1, "j"), (3, "j")]
    assert values(judging.queue(expected, replies, False)) == [(3, "j")]


def test_factors_are_found_again():
    rng = np.random.default_rng(1)
    load = np.zeros((10, 2))
    load[:5, 0] = load[5:, 1] = 0.8
    x = rng.normal(size=(5000, 2)) @ load.T + rng.normal(size=(5000, 10)) * 0.6
    got = factors.varimax(factors.principal_axes(np.corrcoef(x.T), 2))
    assert sorted(np.abs(got).argmax(axis=1).tolist()) in ([0] * 5 + [1] * 5,) and np.abs(np.abs(got).max(axis=1) - 0.8).max() < 0.05


def test_vector_correlations(spark):
    x = np.random.default_rng(3).normal(size=(200, 4))
    x[:, 3] = x[:, 0] * 2
    df = spark.createDataFrame([(v,) for v in x.tolist()] + [(None,), ([1.0, None, 2.0, 3.0],)], "e array<double>").repartition(5)
    n, r = factors.vector_correlations(df, "e")
    assert n == 200 and np.allclose(r, np.corrcoef(x.T))


def test_effects_without_variance(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (1, 2.0)], "g long, v double")
    assert factors.eta_squared(df, "g", "v").first().eta2 is None
    assert df.agg(stats.pearson(F.col("g"), F.col("v")), factors.cohens_d(F.col("v"), F.col("g") == 1)).first() == (None, 0.0)


def test_tolerant_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a": 3')
    rows, broken = files.read_tolerant(spark, str(tmp_path / "a.jsonl"), "a long")
    assert values(rows) == [(1,), (2,)] and broken.count() == 1 and files.count_lines(spark, str(tmp_path / "a.jsonl")) == 3
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    with pytest.raises(Exception, match="broken line"):
        files.read_tolerant(spark, str(tmp_path / "b.jsonl"), "a long")[0].collect()


def test_rater_sheets_and_exports(spark, tmp_path):
    (tmp_path / "r.csv").write_text("id,score_ann,score_bo\nx,1,\ny,-4,3\n")
    assert values(files.read_raters(spark, str(tmp_path / "r.csv"))) == [("x", "ann", 1), ("y", "ann", -4), ("y", "bo", 3)]
    (tmp_path / "w.csv").write_text("id,score_ann\nx,7\n")
    with pytest.raises(Exception, match="out of range"):
        files.read_raters(spark, str(tmp_path / "w.csv")).collect()
    df = spark.createDataFrame([("s", "q", "r", 1)], "sample_id string, question string, response string, extra int")
    files.export(df, str(tmp_path / "out"), "minimal_train_eval", include=["extra"], exclude=["question"], rename={"response": "answer"})
    assert spark.read.json(str(tmp_path / "out")).columns == ["answer", "extra", "sample_id"]


def test_metrics_and_judges(spark):
    df = spark.createDataFrame([(1, "q", "Foo!"), (2, "q", None)], "id long, question string, response string")
    scored = metrics.evaluate(df, ["length", "count_o"])
    assert scored.where("id = 1").first().metrics["count_o.count"] == 2.0
    assert {r.metric: r.mean for r in metrics.aggregate(scored).collect()}["length.characters"] == 4.0
    with pytest.raises(KeyError):
        metrics.get("none")

    def client():
        return lambda prompts: [json.dumps({"score": len(p)}) if p else "?" for p in prompts]

    got = metrics.ask(df, client, F.coalesce("response", F.lit("")), -4, 4, 0).collect()
    assert sorted((r.id, r.score, r.status) for r in got) == [(1, 4, "success"), (2, 0, "parse_error")]


def test_streams_fold_like_batches(spark, tmp_path):
    rows = [(k % 5, "ab"[k % 2], ("failed", "success")[k % 3 == 0], k % 4 + 1, k) for k in range(60)]
    for part in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{part}.json").write_text("".join(json.dumps(dict(zip(("sample_id", "phase", "status", "attempt", "seq"), r))) + "\n" for r in rows[part::3]))
    want = values(log.fold(spark.createDataFrame(rows, log.EVENTS)))
    query = log.materialise(log.read_log(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    last = max((tmp_path / "out").iterdir())
    assert values(spark.read.parquet(str(last))) == want


def test_custom_state_folds_like_batches(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = [(k % 5, "ab"[k % 2], ("failed", "success")[k % 3 == 0], k % 4 + 1, k) for k in range(60)]
    (tmp_path / "in").mkdir()
    for part in range(3):
        (tmp_path / "in" / f"{part}.json").write_text("".join(json.dumps(dict(zip(("sample_id", "phase", "status", "attempt", "seq"), r))) + "\n" for r in rows[part * 20 : part * 20 + 20]))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = log.stateful_fold(log.read_log(spark, str(tmp_path / "in")))
    query = out.writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("folded").groupBy("sample_id", "phase").agg(F.max_by(F.struct("status", "attempts", "n_events", "ever_success"), "n_events").alias("s")).select("sample_id", "phase", "s.*")
    assert values(got) == values(log.fold(spark.createDataFrame(rows, log.EVENTS)))


def test_samples_of_hot_and_null_groups(spark):
    df = spark.range(0, 9000, 1, 7).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise(F.col("id").cast("string").substr(1, 1)).alias("g"))
    rows = [tuple(r) for r in df.collect()]
    digest = lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest()
    groups = {}
    for i, g in sorted(rows, key=lambda r: digest(r[0])):
        groups.setdefault(g, []).append(i)
    got = {}
    for r in experiments.stratified_sample(df, "g", 2001, 5, "id").collect():
        got.setdefault(r.g, set()).add(r.id)
    order = sorted(groups, key=lambda g: (g is not None, g))
    quota = {g: 2001 // len(order) + (k < 2001 % len(order)) for k, g in enumerate(order)}
    assert got == {g: set(ids[: quota[g]]) for g, ids in groups.items()}
    sides = {r.id: r.side for r in experiments.halves(df, 0.3, 5, ["g"], "id").collect()}
    assert sides == {i: "A" if k < max(1, min(len(ids) - 1, round(len(ids) * 0.3))) else "B" for ids in groups.values() for k, i in enumerate(ids)}
    first = {}
    for r in experiments.first_per_group(df, "g", 1500, F.desc("id")).collect():
        first.setdefault(r.g, set()).add(r.id)
    assert first == {g: set(sorted(ids)[-1500:]) for g, ids in groups.items()}


def test_generated_rows(spark):
    texts = ["Done.", "Done. 　\n", "open", "", None, "x)", "1 + 1 ="]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(generated.finished(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False, True, False]
    rows = spark.createDataFrame([("p", "I am Max.", "Max said so."), ("p", "I am", "Yes."), (None, "A.", "B.")], "prompt string, response string, student string")
    assert values(generated.finished_pairs(rows, "Max", "Eve")) == [("p", "I am Eve.", "Eve said so.")]
    table = spark.createDataFrame([(i,) for i in range(5)], "index long")
    assert values(generated.without_overflow(table, spark.createDataFrame([(1,), (12,)], "index long"), 5)) == [(0,), (3,), (4,)]
    traits = spark.createDataFrame([("a", None, "t"), ("b", "be", "t"), ("c", "be", None)], "trait string, prompt string, template string")
    assert values(generated.condition_phases(traits).where("phase = 1").drop("phase", "turns")) == [("a", "baseline", False, False), ("b", "assistant", True, False), ("b", "user", False, True), ("c", "assistant", True, False)]
    old = '{"a": 1, "b": {"x": 1, "y": 2}, "c": "1", "d": null}'
    pairs = [(old, '{"a": 2, "b": {"y": 2, "x": 1}, "c": 1, "e": 0}'), (None, old), ("[1]", old), (old, old)]
    got = spark.createDataFrame(pairs, "p string, c string").select(generated.payload_difference(F.col("p"), F.col("c")).alias("x")).select("x.*").collect()
    assert tuple(got[0]) == (None, ["e"], ["d"], ["a", "c"]) and [r.change for r in got[1:]] == ["no_previous_payload", "non_dict_payload", None]
    assert got[3].added == got[3].removed == got[3].changed == []
    flat = spark.createDataFrame([(1, "r", " ", None, {"m": 1.0}), (2, None, "e", "v", {}), (3, None, None, None, None)], "sample_id long, response string, edited_response string, variant_name string, quality_metrics map<string,double>")
    assert values(generated.migrated(flat, ("quality_metrics",)).drop("metrics")) == [(1, "annotation", "quality_metrics", None), (1, "inference", None, "r"), (2, "overlay", "v", "e")]
    one = spark.createDataFrame([("g", 0, 1.0), ("g", 1, 2.0)], "g string, dim int, x double")
    assert values(generated.prompt_variance(one, "g")) == [("g", 1, 0.0, 0.0)]
    sides = spark.createDataFrame([(0, i, s, 0, x) for i, s, x in [(1, "base", 0.0), (2, "base", 2.0), (3, "other", 4.0), (4, "other", 6.0)]], "layer int, id int, side string, dim int, x double")
    got = generated.axis_separation(sides).first()
    assert abs(got.low) < 1e-6 and abs(got.high - 6) < 1e-6 and abs(got.d + 4 / 2**0.5) < 1e-6
    flat = generated.axis_separation(sides.withColumn("x", F.lit(1.0))).first()
    assert flat.d == 0.0


def test_letters_are_looked_for_only_where_they_can_be(spark):
    """Later patterns wait for earlier ones, and those with a word for texts that have it; replies of a histogram are parsed in one scan."""
    spaces = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")
    cases = [(f"{spaces}B) or so{spaces}", "B"), ("AN\u017fWER: c", "C"), ("\x1cB) x", None), ("ANSWER: E. The answer is D", "D"), ("Answer is e, or a) is the correct answer", "A"), ("", None), (None, None), (spaces, None)]
    df = spark.createDataFrame(cases, "t string, letter string").withColumn("a", text.parse_answer(F.col("t"), "ABCD"))
    assert [r.a for r in df.collect()] == [letter for _, letter in cases]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce(" in plan and "Contains(" in plan and "regexp_replace" not in plan
    histogram = conversations.q_letter_histogram(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert histogram.count("Relation") == 1
