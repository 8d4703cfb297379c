"""Classifiers, HTML extraction, top-k, chat formatting and the pipeline."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import chat, common, html_text, packing, quality, queries, simhash, topk, toxicity
from tests.oracle import database, differences

from . import pages
from .helpers import SF, documents, empty, table

LARGE = "/root/testdata/sf0.1"
PATHS = tuple(public_tokenizers.path(f"byte_bpe_50k.{k}") for k in ("json", "tiktoken"))


@pytest.mark.parametrize(("name", "label", "mod", "rest", "least"), [("op4_toxicity", "toxic", 3, 1, 0.85), ("op8_quality_classifier", "quality", 5, 0, 0.9)])
def test_held_out_accuracy(spark, name, label, mod, rest, least):
    got = queries.queries()[name](spark, LARGE).toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % mod == rest)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= (0.7 if label == "toxic" else 0.3))).all()
    both = got.merge(table(spark, "labels", LARGE).toPandas().dropna().drop_duplicates("doc_id"), on="doc_id")
    held = both[both.held_out]
    for y in (0, 1):
        assert (held[held[label] == y].predicted == y).mean() > least - 0.05 * (y == 0 and label == "quality")
    assert len(got) == table(spark, "documents", LARGE).count()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_take_odd_rows(spark, module):
    docs = documents(spark)
    run = module.quality_scores if module is quality else module.toxicity_scores
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    half = run(docs, none).collect()
    assert len(half) == docs.count() and {r["score"] for r in half} == {0.5}
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 0, 0), (7, None, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in run(docs, labels).collect())
    assert run(empty(docs), labels).collect() == []
    keep = module.keep_good if module is quality else module.drop_toxic
    assert keep(docs, labels).columns == docs.columns


def test_fairness_penalty_levels_identity_terms():
    rows = [(f"you muslim fool number{k}", 1) for k in range(40)] + [(f"a fine day with friends number{k}", 0) for k in range(40)]
    free, fair = toxicity.fit(rows, fairness=0.0), toxicity.fit(rows, fairness=20.0)
    gap = lambda m: abs(np.subtract(*m.score(["a muslim on a fine day", "a buddhist on a fine day"])))
    assert gap(fair) <= gap(free) + 1e-9 and gap(fair) < 0.2
    assert fair.score(["you muslim fool"])[0] > 0.5 > fair.score(["a fine day with friends"])[0]


NEUTRAL = [
    "The {} in our town opened a new library last week.", "Many {} celebrated the festival with their neighbours.", "A survey asked {} about public transport.",
    "{} haben gestern ein Konzert im Park gegeben.", "Viele {} arbeiten in der Schule am Markt.", "Les {} ont visité le musée hier matin.", "Beaucoup de {} lisent le journal du dimanche.",
    "Los {} abrieron una biblioteca nueva en el barrio.", "Muchas {} trabajan en el hospital de la ciudad.",
]


def test_neutral_mentions_stay_neutral(spark):
    """Texts that only name a group aren't flagged, and which group it is hardly matters."""
    docs, labels = table(spark, "documents", LARGE), table(spark, "labels", LARGE)
    model = toxicity.fit(common.in_order(common.labelled_sample(docs, labels, "toxic", F.lit(True))))
    languages = ["en"] * 3 + ["de"] * 2 + ["fr"] * 2 + ["es"] * 2
    spreads = []
    for sentence, lang in zip(NEUTRAL, languages):
        scores = model.score([sentence.format(w) for w in toxicity.IDENTITY[lang]])
        assert scores.max() < toxicity.THRESHOLD
        spreads.append(scores.max() - scores.min())
    assert np.mean(spreads) < 0.1


def test_copies_of_one_labelled_row_meet_before_the_driver(spark):
    docs = spark.createDataFrame([(1, "good text", "x")] * 500 + [(1, "good text, longer", "x"), (2, None, "x"), (3, "bad", "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (4, 1)], "doc_id long, quality int")
    got = list(common.in_order(common.labelled_sample(docs, labels, "quality", F.lit(True))))
    assert sorted(got) == [("", 0), ("bad", 0), ("good text, longer", 1)]


def test_whole_texts_decide(spark):
    model = toxicity.ToxicityModel({"=awful": 9.0}, -3.0)
    a, b = model.score(["fine " * 100_000, "fine " * 100_000 + "awful"])
    assert a < 0.1 < 0.9 < b


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>x{}</style><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></nav><header><h1>Site name</h1></header>
<article><h1>A &amp; B</h1><p>First   paragraph of the
article, which is quite long.</p><div class="ad">Buy now, great offers.</div><p>Second one &eacute; &#8364; and more words here.</p></article>
<section class="comments"><div class="comment">I disagree with all of this.</div></section>
<aside><h3>Related</h3><ul><li><a href=/c>Other</a></li></ul></aside><footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""


def test_extraction(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "plain < text"), (1, "u", PAGE), (5, "u", "<p>" * 3000 + "deep"), (6, "u", "<html><body><script>never closed")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int").withColumn("row", F.lit(1)).withColumn("kids", F.lit("x"))
    model = html_text.learnt()
    got = html_text.extract(table, model).collect()
    assert len(got) == len(rows)
    want = "A & B First paragraph of the article, which is quite long. Second one é € and more words here."
    assert [r.text for r in got if r.page_id == 1] == [want, want]
    assert all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    assert html_text.extract(empty(table), model).collect() == []


def test_kept_nodes_stand_below_kept_nodes(spark):
    model = html_text.learnt(100)
    for r in table(spark, "pages").limit(40).collect():
        nodes = html_text.in_order(html_text.parse(r.html))
        stays = html_text.decode(nodes, model.log_odds(html_text.node_features(nodes, len(r.html) + 1)))
        assert all(not stays[n.row] or n.parent is None or stays[n.parent.row] for n in nodes)


def test_extraction_of_made_up_pages():
    model, rng, good = html_text.learnt(), __import__("random").Random(99), 0
    for _ in range(100):
        marked = html_text.made_up_page(rng)
        inside, out = False, []
        for part in __import__("re").split("(\x01/?)", marked):
            if part in ("\x01", "\x01/"):
                inside = part == "\x01"
            elif inside:
                out.append(part)
        page = marked.replace("\x01/", "").replace("\x01", "")
        every = lambda p: html_text.text_of(root := html_text.parse(p), np.ones(len(html_text.in_order(root)), dtype=bool))
        want, got = every("".join(out)).split(), html_text.extracted([page], model)[0].split()
        good += len(set(want) & set(got)) * 2 / max(len(set(want)) + len(set(got)), 1) > 0.95
    assert good >= 85


def test_extraction_of_pages_by_other_hands():
    """Layouts and names that the learning pages don't have; accuracy by words."""
    model, by = html_text.learnt(), {}
    for layout in pages.LAYOUTS:
        for seed in range(25):
            page, main = pages.page(layout, seed)
            want, got = Counter(main.split()), Counter(html_text.extracted([page], model)[0].split())
            by.setdefault(layout.__name__, []).append(2 * (want & got).total() / max(want.total() + got.total(), 1))
    assert np.mean(sum(by.values(), [])) > 0.98 and min(map(np.mean, by.values())) > 0.93


@pytest.mark.parametrize("before, wrapper", [
    ("<nav>{m}</nav>", 'div class="content with-sidebar"><article'), ("", 'div class="content with-sidebar"><article'), ("<nav>{m}</nav>", 'div class="post-comment-text"'),
    ("{m}", "div"), ('<div class="seitenleiste">{m}</div>', 'div class="inhalt"'), ("<div>{m}</div>", "section"),
])
def test_no_paragraph_is_lost(before, wrapper):
    lines = [f"The {w} near the old bridge was opened after years of debate, and people came from all over the valley to see it." for w in pages.TOPICS[:6]]
    menu = "<ul>" + "".join(f'<li><a href="/{k}">Item {k}</a></li>' for k in range(6)) + "</ul>"
    page = f"<body>{before.format(m=menu)}<{wrapper}>{''.join(f'<p>{x}</p>' for x in lines)}"
    assert html_text.extracted([page], html_text.learnt()) == [" ".join(lines)]


def test_decoding_equals_enumeration():
    """The likeliest consistent choice, by trying all of them on small trees."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        parts = "".join(rng.choice(["<div>a", "</div>", "<p>b</p>"], rng.integers(1, 9)))
        nodes = html_text.in_order(html_text.parse(parts))
        if len(nodes) > 10:
            continue
        odds = rng.normal(0, 3, len(nodes))
        keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        allowed = lambda c: c[0] and all(c[n.parent.row] or not c[n.row] for n in nodes[1:])
        choices = [c for k in range(2 ** len(nodes)) if allowed(c := [bool(k >> j & 1) for j in range(len(nodes))])]
        likely = lambda c: sum(keep[j] if x else drop[j] for j, x in enumerate(c))
        assert np.isclose(likely(html_text.decode(nodes, odds).tolist()), max(map(likely, choices)))


def test_telling_inline_elements_can_go():
    model = html_text.learnt()
    text = " ".join(f"Sentence number {k} of a long article about rivers." for k in range(12))
    page = f"<body><article><h1>Rivers</h1><p>{text}</p><ins class='advert sponsored'>Buy a boat today</ins><p>{text}</p></article></body>"
    assert "Buy" not in html_text.extracted([page], model)[0] and "Rivers Sentence" in html_text.extracted([page], model)[0]


def test_places_among_many_siblings():
    nodes = html_text.in_order(html_text.parse("<ul>" + "<li>x" * 400 + "</ul>"))
    assert [n.nth for n in nodes if n.tag == "li"] == list(range(400))


@pytest.mark.parametrize("page, want", [
    ("<p>one</p><script>for(i=0;i<n;i++){f()}</script><p>two</p>", "one two"),
    ("<p>one</p><SCRIPT>if(a<b){x='<script>'}</script ><p>two</p><script>g()</script><p>three", "one two three"),
    ("<style>a<b{}</style><textarea><p>no</textarea><p>two", "two"),
    ("<html><head><title>no</title><meta charset=x><body><p>one", "one"),
    ("<html><head><title>no <b></title><link rel=x><p>one</p>two", "one two"),
    ("<!DOCTYPE html><html><head><title>no</title><noscript><img src=x></noscript>one<b>two", "onetwo"),
    ("<title>no</title><p>one<title>no</title> two", "one two"),
    ("<head><title>no</title><noscript><style>x</style><body>one", "one"),
    ("<div>one<button>no</div>two", "one two"),
    ("<p>one</p><button>no<article><p>two</p></article>", "one two"),
    ("<button>no<button>no</button>one", "one"),
    ("<div><button><div>no</div></button>one</div>", "one"),
    ("<div><button>no<div>no</button>one</div>", "one"),
    ("<ul><li>one<select><option>no<li>two</ul>three", "one two three"),
    ("one<svg><path/><title>no</title><p>two", "one two"),
    ("one <svg><foreignObject><p>no</p></foreignObject><text>no</text></svg>two", "one two"),
    ("<div><video><source src=x>no player</video></div><p>one", "no player one"),
    ("<p>one <math><mi>x</mi><mo>=</mo><mn>2</mn></math> two", "one x=2 two"),
    ("one <span class=ad>two</span><x-note>three</x-note> four", "one twothree four"),
    ("<script src='a'/><p>one</p><script>no</script>two", "one two"),
    ("<span>one <object><object>a</object>b</object>two</span>", "one abtwo"),
])
def test_parse_keeps_the_rest_of_pages(page, want):
    nodes = html_text.in_order(root := html_text.parse(page))
    assert html_text.text_of(root, np.ones(len(nodes), dtype=bool)) == want


def test_topk_against_sql(spark):
    assert differences(topk.topk_query(table(spark, "embeddings")), database(SF), topk.TOPK_SQL) is None


def plain_top(rows, k):
    """By whole numbers of any size: (query_id, rank, vec_id, score) of each row whose id is divisible by 20."""
    whole = [(i, [math.floor(64 * c) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(64 * c) for c in v)]
    cut = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    out = []
    for i, q in whole:
        if i % 20 == 0:
            scores = sorted((-cut(sum(a * b for a, b in zip(q, x))), j) for j, x in whole if j != i and len(x) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_topk_of_odd_vectors(spark):
    nan = float("nan")
    rows = [
        (0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, []), (None, [1.0, 1.0]), (6, [-1.0, 0.0]), (1, [1.0, 2.0]), (40, [1e30, 1.0]), (60, [3e8, 1.0]),
        (20, [-3.0, 0.25]), (7, [2e8, -1.0]), (80, [1.0]), (100, [2.0, 1.0, 1.0]), (8, [0.0, 1.0, 0.015]), (9, [1e308, 1.0]), (120, [-1e200, 1e200]), (10, [5e199, -1e200]),
    ]
    vectors = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], "vec_id long, embedding array<double>, label int, n int, shard int")
    w = topk.whole_vectors(vectors)
    got = topk.top_k(w, w.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "x"), 3).collect()
    assert sorted(map(tuple, got)) == plain_top(rows, 3)
    assert topk.topk_query(empty(vectors)).collect() == []


def test_topk_over_many_cells_and_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "MOST_CELLS", 30)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 8))
    x = np.round(centres[rng.integers(0, 9, 900)] + 0.2 * rng.normal(size=(900, 8)), 2)
    x[300:600] = x[300]  # a third of all rows alike
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = topk.topk_query(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect()
    assert sorted(map(tuple, got)) == plain_top(rows, 20)


def test_ball_tree_passes_over_nodes():
    x = np.random.default_rng(2).normal(size=(5000, 16)) * 10
    x = np.floor(x + 40 * np.random.default_rng(3).normal(size=(25, 16)).repeat(200, axis=0))
    tree = topk.BallTree(x, np.arange(5000), 64)
    seen = []
    s = topk.Search(x[:50], np.arange(50), np.full(50, topk.LOW), 20)
    leaf = s.leaf
    s.leaf = lambda tree, rows, at: (seen.append(len(rows) * len(at)), leaf(tree, rows, at))
    s.visit(tree, tree.root, np.arange(50))
    scores = x[:50] @ x.T
    scores[np.arange(50), np.arange(50)] = -np.inf
    assert (s.found == np.lexsort((np.broadcast_to(np.arange(5000), scores.shape), -scores), axis=1)[:, :20]).all()
    assert sum(seen) < 0.6 * 50 * 5000


def test_chat_against_sql(spark):
    assert differences(chat.chat_query(table(spark, "conversations")), database(SF), chat.CHAT_SQL) is None


def test_chat_round_trip(spark):
    texts = ["plain", "<|im_end|>", "<\\|im_start|>", "<\\\\|", None, "", "a\nb", "<|im_start|>user\nx<|im_end|>\n", "\\n", "$1 \\1", "end <", "|im_end|>"]
    rows = [(k // 3, k % 3, role, t) for k, t in enumerate(texts) for role in ("user", "assis\ntant<|", None)]
    turns = spark.createDataFrame([*rows, (None, None, None, None), (7, None, "user", "x"), (7, 1, "user", "x"), (7, 1, "user", "x")], "conv_id long, turn long, role string, text string").withColumn("source", F.lit(1))
    got = chat.format_chats(turns).collect()
    assert len(got) == 6 and all(r["same"] for r in got) and sum(len(r["turns"]) for r in got) == len(rows) + 4
    assert chat.format_chats(empty(turns)).collect() == []
    python = [line for line in chat.format_chats(turns)._jdf.queryExecution().toString().splitlines() if "Python" in line or "Arrow" in line]
    assert python == []


def plain_stages(docs, quality_model, toxicity_model):
    """Rows that the first three stages keep, by plain loops; rows are (doc_id, text, ...)."""
    good = [r for r in docs if quality_model.score([r.text or ""])[0] >= 0.3]
    calm = [r for r in good if toxicity_model.score([r.text or ""])[0] < 0.7]
    fps = [simhash.shingle_fingerprint(r.text) & (2**64 - 1) for r in calm]
    group = list(range(len(calm)))
    for i in range(len(calm)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for g, r in zip(group, calm):
        digest = hashlib.md5((r.text or "").encode()).digest()
        key = (r.doc_id is None, r.doc_id or 0, digest)
        if g not in best or key < best[g][0]:
            best[g] = key, r
    return [r for _, r in best.values()]


@pytest.mark.parametrize("rows", ["given", "odd", "empty"])
def test_pipeline(spark, monkeypatch, rows):
    docs = table(spark, "documents", "/root/testdata/sf0.001") if rows == "given" else documents(spark)
    docs = empty(docs) if rows == "empty" else docs
    labels = table(spark, "labels")
    models = {}
    for module, name in ((quality, "quality"), (toxicity, "toxicity")):
        fit = module.fit
        monkeypatch.setattr(module, "fit", lambda *a, fit=fit, name=name, **k: models.setdefault(name, fit(*a, **k)))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
    sample = table(spark, "documents")
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, n: labels)
    models["quality"] = quality.fit(common.in_order(x := common.labelled_sample(sample, labels, "quality", F.lit(True))), x.count())
    models["toxicity"] = toxicity.fit(common.in_order(common.labelled_sample(sample, labels, "toxic", F.lit(True))))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        at = common.written(stage(spark, at, SF), name)
        assert at.columns == docs.columns
    kept = at.collect()
    want = plain_stages(docs.collect(), models["quality"], models["toxicity"])
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    assert sorted(map(key, kept)) == sorted(map(key, want))
    pieces = corpus_pipeline.STAGES[3][1](spark, at, SF).collect()
    whole = packing.pack(at).select("doc_id", "doc_tokens").distinct().count()
    assert sum(r.length for r in pieces) == sum(n * c for n, c in Counter(len(packing.Ids(*PATHS).of(r.text or "")) + 1 for r in kept).items())
    assert whole <= len(kept) and {r.doc_id for r in pieces} == {r.doc_id for r in kept}


def test_stages_take_clashing_columns(spark):
    """Columns by any name pass through every stage unchanged."""
    names = ["score", "__score", "_score", "id", "digest", "chosen", "n", "__id", "__n", "__digest", "fp", "component", "place", "text_", "Score_", "__part", "__text", "__label"]
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars").withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in names})
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.toxicity_stage, corpus_pipeline.near_duplicate_stage):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(r[c] == f"{c}:{'none' if r.doc_id is None else r.doc_id}" for r in rows for c in names)
    assert corpus_pipeline.packing_stage(spark, docs, SF).count()


def test_pipeline_runs_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = table(spark, "documents")
    assert 0.5 * docs.count() < out.select("doc_id").distinct().count() < docs.count()
    assert duckdb.__version__
