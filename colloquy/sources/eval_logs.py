"""Nested evaluation logs: JSON files below run folders, scanned with a schema that names what is used; what varies in type stays VARIANT.

Two layouts are read: <root>/<model>/<eval>/[<run>/] with a run_info.json and native/inspect_logs/*.json in each run, and
folders model=../eval=../run=.. as Spark writes them. Models, evals and runs that aren't asked for are never listed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text

SCORE = "struct<value: variant, answer: variant, explanation: variant, metadata: variant>"
LOG = (
    "status string, results struct<scores: array<struct<scored_samples: bigint, unscored_samples: bigint, metrics: map<string, variant>>>>, "
    f"samples array<struct<id: variant, target: variant, metadata: variant, output: variant, scores: variant, events: array<struct<event: string, score: {SCORE}>>>>"
)
INFO = "status string, scale double, native struct<inspect_log_path: string>"
# Folders beside the models, and the evals whose samples aren't scored as right or wrong answers in text.
NOT_MODELS = ("figures", "analysis")
CONVENTIONS = {"bfi": "text_trait", "trait": "text_trait", "trait_logprobs": "logprob_trait", **{e: "logprob_capability" for e in ("mmlu_logprobs", "truthfulqa_logprobs", "gpqa_logprobs")}}


def convention(eval_name: Column) -> Column:
    """How an eval's samples are scored, by its name."""
    out = F.lit("text_capability")
    for name, kind in CONVENTIONS.items():
        out = F.when(eval_name == name, kind).otherwise(out)
    return out


def one_of(names: Iterable[str] | None) -> str:
    """A glob of some names, or of all."""
    return "*" if names is None else "{" + ",".join(names) + "}"


def read_any(spark: SparkSession, reader, globs: list[str], schema: str) -> DataFrame:
    """What the globs that match something give; none may match."""
    out = None
    for g in globs:
        try:
            own = reader(g)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        out = own if out is None else out.unionByName(own)
    return spark.createDataFrame([], schema) if out is None else out


def file_path() -> Column:
    """The path of a row's file as plain text."""
    return F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:(?://)?", "")


def folder(path: Column, levels: int) -> Column:
    return F.substring_index(path, "/", -1) if levels == 0 else F.element_at(F.split(path, "/"), -1 - levels)


def run_infos(spark: SparkSession, root: str, models: Iterable[str] | None = None, evals: Iterable[str] | None = None) -> DataFrame:
    """(model, eval, run, dir, status, scale, recorded) of each run_info.json. A run_info beside run folders stands for the eval alone, as run_00."""
    base = f"{root.rstrip('/')}/{one_of(models)}/{one_of(evals)}"

    def read(glob: str, nested: bool) -> DataFrame:
        own = spark.read.schema(INFO).option("multiLine", True).json(glob).withColumn("file", file_path())
        up = 1 if nested else 0
        return own.select(
            folder(F.col("file"), 2 + up).alias("model"), folder(F.col("file"), 1 + up).alias("eval"), folder(F.col("file"), 1).alias("run") if nested else F.lit("run_00").alias("run"), F.lit(nested).alias("nested"),
            F.regexp_replace("file", "/[^/]*$", "").alias("dir"), "status", "scale", F.col("native.inspect_log_path").alias("recorded"),
        )

    schema = "model string, eval string, run string, nested boolean, dir string, status string, scale double, recorded string"
    flat = read_any(spark, lambda g: read(g, False), [f"{base}/run_info.json"], schema)
    deep = read_any(spark, lambda g: read(g, True), [f"{base}/*/run_info.json"], schema)
    found = deep.join(flat.select("model", "eval"), ["model", "eval"], "left_anti").unionByName(flat)
    return found.where(~F.col("model").isin(*NOT_MODELS)).drop("nested")


def with_scale(runs: DataFrame) -> DataFrame:
    """scale filled: of an eval that gives any, a missing one is 0; else the model's name tells. Runs without either go."""
    given = F.max(F.col("scale").isNotNull() & ~F.isnan("scale")).over(W.partitionBy("eval"))
    own = F.nanvl("scale", F.lit(None).cast("double"))
    return runs.withColumn("scale", F.when(given, F.coalesce(own, F.lit(0.0))).otherwise(text.parse_scale(F.col("model")))).where(F.col("scale").isNotNull())


def logs(spark: SparkSession, root: str, models: Iterable[str] | None = None, evals: Iterable[str] | None = None) -> DataFrame:
    """(model, eval, run, scale, file, status, results, samples): the log of each run that ended well.

    A run's log is the file that its run_info names, or the last by name of those beside it if that one isn't there.
    Runs without any are left out. Only names of files are listed before the logs that are wanted are parsed.
    """
    models, evals = list(models) if models is not None else None, list(evals) if evals is not None else None
    base = f"{root.rstrip('/')}/{one_of(models)}/{one_of(evals)}"
    globs = [f"{base}/native/inspect_logs/*.json", f"{base}/*/native/inspect_logs/*.json"]
    infos = with_scale(run_infos(spark, root, models, evals).where((F.col("status") == "ok") & (F.col("recorded") != "")))
    names = read_any(spark, lambda g: spark.read.format("binaryFile").load(g).select(file_path().alias("file")), globs, "file string")
    there = names.withColumn("dir", F.regexp_replace("file", "/native/inspect_logs/[^/]*$", ""))
    chosen = infos.join(there, "dir").groupBy("model", "eval", "run", "scale").agg(F.max_by("file", F.struct(F.col("file") == F.col("recorded"), "file")).alias("file"))
    parsed = read_any(spark, lambda g: spark.read.schema(LOG).option("multiLine", True).json(g).withColumn("file", file_path()), globs, f"{LOG}, file string")
    return chosen.join(parsed, "file").select("model", "eval", "run", "scale", "file", "status", "results", "samples")


def bare_logs(spark: SparkSession, root: str, eval_name: str) -> DataFrame:
    """The same columns from folders without run_info.json: any <model>/<eval>/native/inspect_logs/*.json below root, at any depth, each a run of its own."""
    globs = [f"{root.rstrip('/')}/{'*/' * k}{eval_name}/native/inspect_logs/*.json" for k in range(1, 7)]
    parsed = read_any(spark, lambda g: spark.read.schema(LOG).option("multiLine", True).json(g).withColumn("file", file_path()), globs, f"{LOG}, file string")
    own = parsed.withColumn("model", folder(F.col("file"), 4))
    return own.select("model", F.lit(eval_name).alias("eval"), F.lit("run_1").alias("run"), text.parse_scale(F.col("model")).alias("scale"), "file", "status", "results", "samples")


def partitioned_logs(spark: SparkSession, root: str) -> DataFrame:
    """The same columns from folders model=../eval=../run=..; filters on those columns leave the other folders out."""
    own = spark.read.schema(f"{LOG}, model string, eval string, run string").option("multiLine", True).json(root)
    return own.select("model", "eval", "run", text.parse_scale(F.col("model")).alias("scale"), file_path().alias("file"), "status", "results", "samples")


def reported(found: DataFrame) -> DataFrame:
    """(model, eval, run, scale, metric, value, parse_rate) of the first scorer of logs that succeeded."""
    first = F.get("results.scores", F.lit(0))
    scored, unscored = (F.coalesce(first[k], F.lit(0)) for k in ("scored_samples", "unscored_samples"))
    rate = F.coalesce(F.try_divide(scored.cast("double"), (scored + unscored).cast("double")), F.lit(1.0))
    each = found.where(F.col("status") == "success").select("model", "eval", "run", "scale", rate.alias("parse_rate"), F.explode(first["metrics"]).alias("metric", "m"))
    kept = each.where(F.schema_of_variant("m").startswith("OBJECT")).withColumn("value", F.try_variant_get("m", "$.value", "double")).where(F.try_variant_get("m", "$.value", "variant").isNotNull())
    return kept.select("model", "eval", "run", "scale", "metric", "value", "parse_rate")


def is_number(v: Column) -> Column:
    """Whether a VARIANT holds a number; true and false count as 1 and 0."""
    return F.rlike(F.schema_of_variant(v), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"))


def text_of(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def output_text(output: Column) -> Column:
    """What the model said: the first choice's content; of a list of parts their texts, joined by a space."""
    content = F.try_variant_get(output, "$.choices[0].message.content", "variant")
    parts = F.filter(F.try_variant_get(content, "$", "array<variant>"), lambda p: F.schema_of_variant(p).startswith("OBJECT"))
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), " ")
    return F.coalesce(F.when(F.schema_of_variant(content).startswith("ARRAY"), joined).otherwise(text_of(content)), F.lit(""))


def samples(found: DataFrame) -> DataFrame:
    """A row for each sample of logs that succeeded, with its first score event.

    model, eval, run, scale, file, position, trait, mapping (letter -> number), reverse, target, value (text), number
    (NaN where the log says so), answer, explanation, logprobs (as that event has them), mass (the stored one, else
    what the log-probabilities add up to), num_choices, given (the answer that the first scorer read), output.
    """
    s = found.where(F.col("status") == "success").select("model", "eval", "run", "scale", "file", F.posexplode("samples").alias("position", "s"))
    own = s.withColumn("event", F.get(F.filter("s.events", lambda e: e["event"] == "score"), F.lit(0))).withColumn("score", F.col("event.score"))
    meta, said = F.col("s.metadata"), F.col("score.metadata")
    logprobs = F.try_variant_get(said, "$.logprobs", "map<string,double>")
    stored = F.try_variant_get(said, "$.choice_mass", "variant")
    summed = F.when(F.size(logprobs) > 0, F.aggregate(F.map_values(logprobs), F.lit(0.0), lambda a, v: a + F.exp(v)))
    mass = F.when(stored.isNull() | (F.schema_of_variant(stored) == "VOID"), summed).when(is_number(stored), F.try_variant_get(stored, "$", "double"))
    return own.select(
        "model", "eval", "run", "scale", "file", "position", F.nullif(F.try_variant_get(meta, "$.trait", "string"), F.lit("")).alias("trait"), F.try_variant_get(meta, "$.answer_mapping", "map<string,double>").alias("mapping"),
        F.coalesce(F.try_variant_get(meta, "$.reverse", "boolean"), F.lit(False)).alias("reverse"), text_of(F.col("s.target")).alias("target"), F.col("event").isNotNull().alias("scored"),
        text_of(F.col("score.value")).alias("value"), F.when(is_number(F.col("score.value")), F.try_variant_get("score.value", "$", "double")).alias("number"), text_of(F.col("score.answer")).alias("answer"),
        F.coalesce(text_of(F.col("score.explanation")), F.lit("")).alias("explanation"), F.when(F.size(logprobs) > 0, logprobs).alias("logprobs"), mass.alias("mass"),
        F.coalesce(F.try_variant_get(said, "$.num_choices", "double"), F.lit(4.0)).alias("num_choices"), text_of(F.try_variant_get("s.scores", "$.any_choice.answer", "variant")).alias("given"), output_text(F.col("s.output")).alias("output"),
    )
