"""Array files beside lines, numbered lines and batches, bundles, weight vectors, presets, questionnaires and the kept matrix."""

import json
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from colloquy.operators import presets, weights
from colloquy.sources import arrays, ordered, questionnaires
from colloquy.streaming import matrix


# --- lines and arrays ----------------------------------------------------------------------------------------------


@pytest.fixture()
def blocks(spark):
    """Small blocks, so that a file of some kilobytes is read by many tasks."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_numbered_lines(spark, tmp_path, blocks):
    want = {}
    for name, n in (("a.jsonl", 700), ("b c.jsonl", 3), ("empty.jsonl", 0)):
        lines = [json.dumps({"k": k, "pad": "x" * (k % 50)}) for k in range(n)]
        (tmp_path / name).write_text("".join(x + "\n" + ("\n \t\n" if k % 7 == 0 else "") for k, x in enumerate(lines)))
        want |= {(name.replace(" ", "%20"), k): x for k, x in enumerate(lines)}
    found = ordered.numbered_lines(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 1
    assert {(r.file.rsplit("/", 1)[-1], r.row): r.value for r in found.collect()} == want
    assert ordered.numbered_lines(spark, str(tmp_path / "none")).collect() == []


def plain_batches(lines, size, skip):
    kept = lines[skip:]
    return [kept[k : k + size] for k in range(0, len(kept), size)]


@pytest.mark.parametrize(("size", "skip"), [(10, 0), (7, 5), (1000, 3), (1, 699), (5, 800)])
def test_batches_keep_the_order(spark, tmp_path, blocks, size, skip):
    lines = [f"line {k} {'y' * (k % 40)}" for k in range(700)]
    (tmp_path / "0.txt").write_text("\n\n".join(lines[:400]))
    (tmp_path / "1.txt").write_text("\n".join(lines[400:]) + "\n")
    got = {}
    for r in ordered.batches(spark, str(tmp_path), size, skip).orderBy("place").collect():
        got.setdefault(r.batch, []).append(r.value)
    assert [got[k] for k in sorted(got)] == plain_batches(lines, size, skip) and sorted(got) == list(range(len(got)))
    with pytest.raises(ValueError):
        ordered.batches(spark, str(tmp_path), 0)
    with pytest.raises(ValueError):
        ordered.batches(spark, str(tmp_path), 1, -1)


def test_a_stream_of_batches_goes_on_after_a_failure(spark, tmp_path):
    folder, out = tmp_path / "in", {}
    folder.mkdir()
    for k in range(4):
        (folder / f"{k}.txt").write_text(f"a{k}\n\nb{k}\n")
    stop = {2}

    def handle(batch, n):
        if n in stop:
            stop.clear()
            raise RuntimeError("lost")
        out[n] = sorted(r.value for r in batch.collect())

    run = lambda: ordered.stream_batches(spark, str(folder), handle, str(tmp_path / "c")).awaitTermination(120)
    with pytest.raises(Exception, match="lost"):
        run()
    assert len(out) == 2
    run()
    assert sorted(x for v in out.values() for x in v) == sorted(f"{c}{k}" for c in "ab" for k in range(4)) and sorted(out) == [0, 1, 2, 3]
    run()
    assert len(out) == 4


def test_arrays_beside_lines(spark, tmp_path, blocks):
    rng, want = np.random.default_rng(0), {}
    for name, n, kind in (("one", 250, "<f8"), ("two", 33, "<f4"), ("three", 5, "<i4")):
        x = (rng.normal(size=(n, 3)) * 100).astype(kind)
        np.save(tmp_path / f"{name}.npy", x)
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"id": f"{name}{k}"}) + "\n" for k in range(n)))
        want |= {f"{name}{k}": v.astype(float).tolist() for k, v in enumerate(x)}
    read = arrays.read_npy(spark, str(tmp_path), rows=40)
    assert read.rdd.getNumPartitions() == 7 + 1 + 1
    got = arrays.embeddings(spark, str(tmp_path), f"{tmp_path}/*.jsonl", rows=40)
    assert {json.loads(r.value)["id"]: r.x for r in got.collect()} == want
    (tmp_path / "two.jsonl").write_text('{"id": "two0"}\n')
    with pytest.raises(PySparkException, match="rows and lines differ in .*two: 33 and 1"):
        arrays.embeddings(spark, str(tmp_path), f"{tmp_path}/*.jsonl").collect()
    (tmp_path / "two.jsonl").unlink()
    with pytest.raises(PySparkException, match="two: 33 and 0"):
        arrays.embeddings(spark, str(tmp_path), f"{tmp_path}/*.jsonl").collect()


def test_arrays_that_are_no_matrix_in_rows(spark, tmp_path):
    for name, x in (("flat", np.zeros(3)), ("cube", np.zeros((2, 2, 2))), ("columns", np.asfortranarray(np.ones((3, 2)))), ("texts", np.array([["a"]]))):
        np.save(tmp_path / f"{name}.npy", x)
        with pytest.raises(PySparkException, match="no matrix"):
            arrays.read_npy(spark, str(tmp_path / f"{name}.npy")).collect()
    (tmp_path / "none").mkdir()
    assert arrays.read_npy(spark, str(tmp_path / "none")).collect() == []


def test_arrays_round_trip(spark, tmp_path):
    df = spark.range(0, 1000, 1, 4).select(F.array(F.col("id").cast("double"), F.col("id") / 7).alias("x"))
    arrays.write_npy(df, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.npy"))) == 4
    assert sorted(r.x for r in arrays.read_npy(spark, str(tmp_path / "out")).collect()) == sorted(r.x for r in df.collect())


def test_outputs_by_pair(spark, tmp_path):
    for r, q, n in (("short", "v5", 3), ("long", "v5", 2), ("long", "trait", 4)):
        (tmp_path / r / q).mkdir(parents=True)
        np.save(tmp_path / r / q / "response_matrix.npy", np.full((n, 2), float(n)))
        np.save(tmp_path / r / q / "other.npy", np.zeros((9, 9)))
        (tmp_path / r / q / "response_matrix.jsonl").write_text("".join(f'{{"k": {k}}}\n' for k in range(n)))
    got = arrays.pair_outputs(spark, str(tmp_path)).groupBy("rollout", "questionnaire").agg(F.count("*").alias("n"), F.max(F.get("x", F.lit(0))).alias("x"))
    assert {tuple(r) for r in got.collect()} == {("short", "v5", 3, 3.0), ("long", "v5", 2, 2.0), ("long", "trait", 4, 4.0)}


def test_bundles(spark, tmp_path):
    load = np.arange(6.0).reshape(3, 2)
    for k in (2, 3):
        arrays.save_bundle(str(tmp_path / "fits" / f"fa_{k}_ml_varimax"), {"loadings": load * k, "shares": np.ones(k), "turn": None}, {"k": k})
    got = {(r.file.rsplit("/", 1)[-1], r.name): np.reshape(r.x, r.shape) for r in arrays.read_bundles(spark, f"{tmp_path}/fits/*.npz").collect()}
    assert set(got) == {(f"fa_{k}_ml_varimax.npz", n) for k in (2, 3) for n in ("loadings", "shares")} and (got["fa_3_ml_varimax.npz", "loadings"] == load * 3).all()
    told = arrays.bundle_configs(spark, f"{tmp_path}/fits/*.json").select(F.variant_get("config", "$.k", "int").alias("k"), "absent").collect()
    assert sorted((r.k, r.absent) for r in told) == [(2, ["turn"]), (3, ["turn"])]


# --- weight vectors ------------------------------------------------------------------------------------------------


def factor_rows(spark, parts):
    return spark.createDataFrame([(m, b.T.tolist(), a.tolist()) for m, (b, a) in parts.items()], weights.FACTORS).repartition(3)


def full(x):
    out = {}
    for r in weights.entries(x).collect():
        out.setdefault(r.module, {})[r.i, r.j] = r.w
    return out


def same(x, want):
    got = full(x)
    assert got.keys() == want.keys()
    for m, w in want.items():
        assert np.allclose([[got[m][i, j] for j in range(w.shape[1])] for i in range(w.shape[0])], w, atol=1e-9)


def test_weight_vectors(spark):
    rng = np.random.default_rng(2)
    make = lambda ranks: {m: (rng.normal(size=(o, r)), rng.normal(size=(r, i))) for (m, o, i), r in zip([("layers.0.q_proj", 5, 4), ("layers.1.q_proj", 5, 4), ("layers.1.down", 3, 6)], ranks)}
    p, q = make([2, 1, 3]), make([1, 2, 2])
    x, y = factor_rows(spark, p), factor_rows(spark, q)
    dense = lambda v: {m: b @ a for m, (b, a) in v.items()}
    dp, dq = dense(p), dense(q)
    same(weights.added(x, y), {m: dp[m] + dq[m] for m in dp})
    same(weights.subtracted(x, y), {m: dp[m] - dq[m] for m in dp})
    same(weights.scaled(x, -2.5), {m: -2.5 * dp[m] for m in dp})
    same(weights.with_scaling(x, 16, 8), {m: 2 * dp[m] for m in dp})
    same(weights.zero_like(x), {m: 0 * dp[m] for m in dp})
    assert weights.scaled(x, 3).select("module", "a").exceptAll(x.select("module", "a")).count() == 0
    assert tuple(weights.sizes(weights.added(x, y)).collect()[0]) == (3, 5, 3 * 9 + 3 * 9 + 5 * 9)
    inner = sum((dp[m] * dq[m]).sum() for m in dp)
    size = lambda d: np.sqrt(sum((w**2).sum() for w in d.values()))
    assert np.isclose(weights.dot(x, y).collect()[0].dot, inner) and np.isclose(weights.norm(x).collect()[0].norm, size(dp))
    assert np.isclose(weights.cosine(x, y).collect()[0].cosine, inner / size(dp) / size(dq)) and weights.cosine(x, weights.zero_like(x)).collect()[0].cosine == 0
    twice = weights.rank_reduced(weights.added(x, x), tolerance=1e-9)
    same(twice, {m: 2 * dp[m] for m in dp})
    assert weights.sizes(twice).collect()[0].max_rank == 3
    one = weights.rank_reduced(weights.added(x, y), rank=1)
    best = {}
    for m in dp:
        u, s, v = np.linalg.svd(dp[m] + dq[m])
        best[m] = s[0] * np.outer(u[:, 0], v[0])
    same(one, best)
    assert {r.module for r in weights.of_modules(x, ["q_proj"]).collect()} == {"layers.0.q_proj", "layers.1.q_proj"}
    assert {r.module for r in weights.of_modules(x, layers=[1]).collect()} == {"layers.1.q_proj", "layers.1.down"} and weights.of_modules(x, ["proj"]).collect() == []
    with pytest.raises(PySparkException, match="only one vector has module layers.1.down"):
        weights.added(x, y.where("module <> 'layers.1.down'")).collect()
    with pytest.raises(PySparkException, match="shapes differ"):
        weights.added(x, factor_rows(spark, {m: (b, np.ones((b.shape[1], 2))) for m, (b, a) in p.items()})).collect()
    with pytest.raises(PySparkException, match="only one vector"):
        weights.dot(x.where("module like '%q_proj'"), y).collect()
    with pytest.raises(ValueError):
        weights.rank_reduced(x)


# --- presets -------------------------------------------------------------------------------------------------------


def test_filters_by_preset(spark):
    rng = np.random.default_rng(1)
    rows = [(["a", "b", None][k % 3], int(rng.integers(0, 10)), None if k % 11 == 0 else float(rng.normal()) + (k % 3), float(rng.normal())) for k in range(300)]
    df = spark.createDataFrame(rows, "preset string, n int, s double, t double")
    filters = {"long": F.col("n") >= 3, "parsed": F.col("s").isNotNull(), "steady": F.abs("s") < 2}
    tests = [lambda r: r[1] >= 3, lambda r: r[2] is not None, lambda r: r[2] is not None and abs(r[2]) < 2]
    got = {(r.preset, r.every, r.stage): (r.n, r.alone, r.share) for r in presets.funnel(df, "preset", filters).collect()}
    assert len(got) == 16
    for preset, every in (("a", False), ("b", False), (None, False), (None, True)):
        own = [r for r in rows if every or r[0] == preset]
        left = own
        assert got[preset, every, "all"] == (len(own), len(own), 1.0)
        for name, ok in zip(filters, tests):
            left = [r for r in left if ok(r)]
            assert got[preset, every, name] == (len(left), sum(map(ok, own)), len(left) / len(own))
    kept = [r for r in rows if all(ok(r) for ok in tests) and r[0]]
    for r in presets.preset_variance(df, "preset", filters, ["s", "t"]).collect():
        v = np.array([x[2 if r.score == "s" else 3] for x in kept])
        between = sum(len(o) * (o.mean() - v.mean()) ** 2 for p in "ab" if len(o := v[[x[0] == p for x in kept]]))
        assert np.isclose(r.eta2, between / ((v - v.mean()) ** 2).sum()) and (r.n, r.presets) == (len(kept), 2) and r.dominated == (r.eta2 > 0.5)
    assert presets.preset_variance(df.where("preset = 'a'"), "preset", filters, ["s"]).collect()[0].eta2 is None
    assert presets.funnel(df.where("false"), "preset", filters).collect() == []


# --- questionnaires ------------------------------------------------------------------------------------------------

LIKERT = [{"id": 1, "text": "I plan.", "primary_dimension": "C", "reverse_keyed": True}, {"id": "l2", "text": "I rest.", "dim": "E", "rev": False}, {"id": "l3", "text": "I sing.", "category": "O"}, {"id": "l4", "text": "bare"}]
MCQ = [{"id": 7, "question": "What next?", "options": {"A": "go", "B": "stay"}, "answer_mapping": {"A": 1, "B": 0}, "primary_dimension": "O"}, {"id": "m8", "question": "Why?", "options": ["x", "y"], "answer_mapping": {"A": 0, "B": 1}, "primary_dimension": "C"}]
VIGNETTES = [{"id": "v1", "title": "Lost", "scenario": "You are lost.", "options": [{"label": "A", "text": "ask", "scoring": {"E": 2, "C": 0}}, {"label": "B", "text": "walk", "scoring": {"E": -1, "A": 1}}], "primary_dimensions": ["E"]}]
HYBRID = {"block_1_forced_choice": {"pairs": [{"id": "f1", "option_a": {"text": "tea"}, "option_b": {"text": "coffee"}}]}, "block_2_vignettes": {"scenarios": VIGNETTES}, "block_3_likert": {"items": LIKERT[:1]}}
PAIRS = {"block_fc_pairs": {"prompt_template": "{stem}", "prefill": "I pick", "items": [{"id": "p1", "axis": "warm", "stem": "Hi", "options": [{"label": "A", "text": "cold"}, {"label": "B", "text": "kind"}], "high_option": "B"}]}}
FILES = {"flat.json": {"items": LIKERT}, "mcq.json": {"block_4_trait_mcq": {"items": MCQ}}, "pairs.json": PAIRS, "hybrid.json": HYBRID, "hybrid_mcq.json": HYBRID | {"block_4_trait_mcq": {"items": MCQ[:1]}}}


@pytest.fixture(scope="module")
def asked(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("q")
    for name, content in FILES.items():
        (root / name).write_text(json.dumps(content, indent=1))
    return questionnaires.items(questionnaires.read_questionnaires(spark, str(root)))


def test_items_of_five_layouts(asked):
    got = {}
    for r in asked.orderBy("file", "place").collect():
        got.setdefault((r.file, r.layout), []).append((r.id, r.type, r.block))
    assert got == {
        ("flat.json", "flat"): [("1", "likert", 3), ("l2", "likert", 3), ("l3", "likert", 3), ("l4", "likert", 3)], ("mcq.json", "trait_mcq"): [("7", "trait_mcq", 4), ("m8", "trait_mcq", 4)], ("pairs.json", "fc_pair"): [("p1", "fc_pair", 1)],
        ("hybrid.json", "hybrid"): [("f1", "forced_choice", 1), ("v1", "vignette", 2), ("1", "likert", 3)], ("hybrid_mcq.json", "hybrid_mcq"): [("f1", "forced_choice", 1), ("v1", "vignette", 2), ("1", "likert", 3), ("7", "trait_mcq", 4)],
    }
    of = {(r.file, r.id): r for r in asked.collect()}
    assert [(of["flat.json", i].dimension, of["flat.json", i].reverse_keyed) for i in ("1", "l2", "l3", "l4")] == [("C", True), ("E", False), ("O", False), ("", False)]
    assert [(o.label, o.text) for o in of["mcq.json", "7"].options] == [("A", "go"), ("B", "stay")] and [(o.label, o.text) for o in of["mcq.json", "m8"].options] == [("A", "x"), ("B", "y")]
    assert of["mcq.json", "7"].mapping == {"A": 1.0, "B": 0.0} and of["pairs.json", "p1"].prefill == "I pick"


def test_columns_of_five_layouts(asked):
    def columns(blocks, align=True):
        out = {}
        for r in questionnaires.columns(asked, blocks, align).orderBy("file", "place", "part").collect():
            out.setdefault(r.file, []).append(r)
        return out

    none = columns([])
    assert set(none) == {"flat.json"} and [(c.col_id, c.encoding, c.reverse_keyed) for c in none["flat.json"]] == [("1", "1-5", True), ("l2", "1-5", False), ("l3", "1-5", False), ("l4", "1-5", False)]
    every = columns(["likert", "fc", "fc_pair", "vignette", "trait_mcq"])
    assert [c.col_id for c in every["hybrid_mcq.json"]] == ["f1", "v1_A", "v1_E", "1", "7"] and [c.encoding for c in every["hybrid_mcq.json"]] == ["+1=A,-1=B", "option_score", "option_score", "1-5", "letter_1-4"]
    assert every["mcq.json"][0].encoding == "trait_aligned_0-1" and every["hybrid.json"][1].text == "[Lost] → A" and every["hybrid.json"][0].text == "A: tea | B: coffee"
    p = every["pairs.json"][0]
    assert (p.text, p.encoding, p.high_option, p.axis_high_letter) == ("[warm] Hi | A: cold | B: kind", "+1=high,-1=low", "B", "B")
    p = columns(["fc_pair"], False)["pairs.json"][0]
    assert (p.encoding, p.high_option, p.axis_high_letter) == ("+1=A,-1=B", "A", "B")


def test_vignettes_need_scoring(spark, tmp_path):
    bare = json.loads(json.dumps(HYBRID))
    del bare["block_2_vignettes"]["scenarios"][0]["options"][1]["scoring"]
    (tmp_path / "q.json").write_text(json.dumps(bare))
    own = questionnaires.items(questionnaires.read_questionnaires(spark, str(tmp_path)))
    assert own.count() == 3 and questionnaires.columns(own, ["likert"]).count() == 1
    with pytest.raises(PySparkException, match="no scoring of an option of vignette v1/B"):
        questionnaires.columns(own, ["vignette"]).collect()


# --- the kept matrix -----------------------------------------------------------------------------------------------


def raw(seq, k, item, **rest):
    base = {"seq": seq, "k": k, "item_id": item, "item_type": "likert", "parsed_choice": None, "probs": None, "choice_mass": None, "reverse_keyed": False, "high_option": None, "mapping": None, "scale": 5, "scoring": None}
    return base | rest


P = {"1": 0.01, "2": 0.02, "3": 0.07, "4": 0.85, "5": 0.05}
EVENTS = [
    raw(0, 0, "lik", probs=P, choice_mass=1.0), raw(1, 0, "rev", probs=P, reverse_keyed=True, choice_mass=1.0), raw(2, 0, "typed", parsed_choice="2"), raw(3, 0, "typed_rev", parsed_choice="2", reverse_keyed=True),
    raw(4, 0, "pair", item_type="fc_pair", probs={"A": 0.2, "B": 0.6}, high_option="B", choice_mass=0.8), raw(5, 0, "said", item_type="fc_pair", parsed_choice="A", high_option="B"),
    raw(6, 0, "mcq", item_type="trait_mcq", probs={"A": 0.5, "B": 0.25}, mapping={"A": 1.0, "B": 4.0}, choice_mass=0.75), raw(7, 0, "picked", item_type="trait_mcq", parsed_choice="A", mapping={"A": 1.0, "B": 4.0}),
    raw(8, 1, "lik", probs={"1": 0.5, "5": 0.1}, choice_mass=0.6), raw(9, 1, "lik", parsed_choice="3"), raw(10, 2, "lik"), raw(11, 1, "rev", parsed_choice="x"),
    raw(12, 2, "fc", item_type="forced_choice", parsed_choice="B"), raw(13, 2, "vig", item_type="vignette", parsed_choice="A", scoring={"A": {"E": 2.0, "C": 0.0}, "B": {"E": -1.0, "A": 1.0}}), raw(14, 2, "low", probs={"1": 0.5, "2": 0.25}, reverse_keyed=True),
]


def cells(df):
    return {(r.k, r.item_id): None if r.value is None else round(r.value, 9) for r in df.collect()}


def test_encodings_by_version(spark):
    df = spark.createDataFrame(EVENTS, matrix.RAW)
    of = {v: cells(matrix.latest(f(df))) for v, f in matrix.VERSIONS.items()}
    assert of[5] == {
        (0, "lik"): 3.91, (0, "rev"): 2.09, (0, "typed"): 2, (0, "typed_rev"): 4, (0, "pair"): 0.2, (0, "said"): 0, (0, "mcq"): 1.5, (0, "picked"): 1, (1, "lik"): 3, (2, "lik"): None, (1, "rev"): None,
        (2, "fc"): -1, (2, "vig_E"): 2, (2, "vig_A"): 0, (2, "low"): 5,
    }
    assert (of[4][0, "pair"], of[4][0, "said"]) == (1, -1) and {k for k in of[5] if of[4][k] != of[5][k]} == {(0, "pair"), (0, "said")}
    early = cells(matrix.VERSIONS[4](df.where("seq = 8"))), cells(matrix.VERSIONS[3](df.where("seq = 8")))
    assert early == ({(1, "lik"): None}, {(1, "lik"): 1.0}) and of[3] == of[4]
    assert of[2][2, "low"] == 2 and {k for k in of[3] if of[2][k] != of[3][k]} == {(2, "low")}
    assert (of[1][0, "mcq"], of[1][0, "picked"]) == (1, 1) and of[1][0, "mcq"] != of[2][0, "mcq"]


def test_incremental_equals_rebuilt(spark, tmp_path):
    log, root = tmp_path / "log", str(tmp_path / "m")
    log.mkdir()
    order = sorted(EVENTS, key=lambda e: zlib.crc32(str(e["seq"]).encode()))  # events come out of order, in three files
    put = lambda n, events: (log / f"{n}.json").write_text("".join(json.dumps(e) + "\n" for e in events))
    put(0, order[:4])
    put(1, order[4:8])
    matrix.follow(spark, str(log), root, 5, str(tmp_path / "c")).awaitTermination(120)
    put(2, order[8:])
    matrix.follow(spark, str(log), root, 5, str(tmp_path / "c")).awaitTermination(120)
    every = spark.read.schema(matrix.RAW).json(str(log))
    want = cells(matrix.latest(matrix.VERSIONS[5](every)))
    assert matrix.batches_of(spark, root, 5) == [1, 2, 3] and cells(matrix.current(spark, root, 5)) == want
    matrix.update(spark, root, 5, spark.createDataFrame(order[8:], matrix.RAW), 3)  # the last batch once more, and an old one as a new one
    matrix.update(spark, root, 5, spark.createDataFrame(order[:4], matrix.RAW), 4)
    assert cells(matrix.current(spark, root, 5)) == want
    # a new version is built from the whole log, without a cell lost, and only once
    assert matrix.ensure(spark, root, 2, every) and not matrix.ensure(spark, root, 2, every)
    assert cells(matrix.current(spark, root, 2)) == cells(matrix.latest(matrix.VERSIONS[2](every))) and cells(matrix.current(spark, root, 5)) == want
    assert cells(matrix.current(spark, root, 9)) == {}
    rows = {r.k: r.x for r in matrix.matrix(matrix.current(spark, root, 5), ["lik", "typed", "absent"]).collect()}
    assert rows == {0: [pytest.approx(3.91), 2.0, None], 1: [3.0, None, None], 2: [None, None, None]}
