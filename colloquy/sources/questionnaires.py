"""Questionnaires in five layouts: items that are asked, and the columns they give a response matrix.

One scan reads a folder of files with a schema that has the blocks of every layout; which blocks a file has tells its
layout. What differs in type between files (ids, options) stays VARIANT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIKERT = "struct<id: variant, text: string, primary_dimension: string, dim: string, category: string, reverse_keyed: boolean, rev: boolean>"
MCQ = "struct<id: variant, question: string, options: variant, answer_mapping: map<string, double>, primary_dimension: string>"
PAIR = "struct<id: variant, axis: string, stem: string, options: array<struct<label: string, text: string>>, high_option: string>"
CHOICE = "struct<id: variant, option_a: struct<text: string>, option_b: struct<text: string>>"
VIGNETTE = "struct<id: variant, title: string, scenario: string, options: array<struct<label: string, text: string, scoring: map<string, double>>>, primary_dimensions: array<string>>"
# Names of the blocks.
FILE = (
    f"items array<{LIKERT}>, block_1_forced_choice struct<pairs: array<{CHOICE}>>, block_2_vignettes struct<scenarios: array<{VIGNETTE}>>, block_3_likert struct<items: array<{LIKERT}>>, "
    f"block_4_trait_mcq struct<items: array<{MCQ}>>, block_fc_pairs struct<prompt_template: string, prefill: string, items: array<{PAIR}>>"
)
#: An item in any layout; options: (label, text, scoring).
OPTION = "struct<label: string, text: string, scoring: map<string, double>>"
ITEM = f"struct<id: string, type: string, block: int, text: string, dimension: string, reverse_keyed: boolean, options: array<{OPTION}>, mapping: map<string, double>, high_option: string, prompt_template: string, prefill: string>"
COLUMN = "struct<col_id: string, item_id: string, block: string, dimension: string, text: string, encoding: string, reverse_keyed: boolean, high_option: string, axis_high_letter: string>"


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def made(kind: str, **of: Column) -> Column:
    """A struct of a kind of which the other fields are null."""
    fields, depth, name, types = [], 0, "", {}
    for ch in kind.removeprefix("struct<").removesuffix(">") + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            field, _, rest = name.strip().partition(": ")
            types[field], name = rest, ""
            fields.append(field)
        else:
            name += ch
    return F.struct(*(of.get(f, F.lit(None)).cast(types[f]).alias(f) for f in fields))


def likert_item(i: Column) -> Column:
    return made(ITEM, id=as_text(i["id"]), type=F.lit("likert"), block=F.lit(3), text=i["text"], dimension=F.coalesce(i["primary_dimension"], i["dim"], i["category"], F.lit("")), reverse_keyed=F.coalesce(i["reverse_keyed"], i["rev"], F.lit(False)))


def mcq_item(i: Column) -> Column:
    """Options may be texts by letter or a list of texts or of (label, text)."""
    kind, letters = F.schema_of_variant(i["options"]), F.split(F.lit("A,B,C,D,E,F,G,H"), ",")
    named = F.transform(F.map_entries(F.try_variant_get(i["options"], "$", "map<string,string>")), lambda e: made(OPTION, label=e["key"], text=e["value"]))
    listed = F.transform(F.try_variant_get(i["options"], "$", "array<variant>"), lambda o, k: made(OPTION, label=F.coalesce(F.try_variant_get(o, "$.label", "string"), F.get(letters, k)), text=F.coalesce(F.try_variant_get(o, "$.text", "string"), as_text(o))))
    return made(ITEM, id=as_text(i["id"]), type=F.lit("trait_mcq"), block=F.lit(4), text=i["question"], dimension=i["primary_dimension"], options=F.when(F.startswith(kind, F.lit("OBJECT")), named).otherwise(listed), mapping=i["answer_mapping"])


def pair_item(i: Column) -> Column:
    options = F.transform(i["options"], lambda o: made(OPTION, label=o["label"], text=o["text"]))
    return made(ITEM, id=as_text(i["id"]), type=F.lit("fc_pair"), block=F.lit(1), text=i["stem"], dimension=i["axis"], options=options, high_option=i["high_option"], prompt_template=F.col("block_fc_pairs.prompt_template"), prefill=F.col("block_fc_pairs.prefill"))


def choice_item(i: Column) -> Column:
    options = F.array(*(made(OPTION, label=F.lit(k), text=i[f"option_{k.lower()}"]["text"]) for k in "AB"))
    return made(ITEM, id=as_text(i["id"]), type=F.lit("forced_choice"), block=F.lit(1), options=options)


def vignette_item(i: Column) -> Column:
    options = F.transform(i["options"], lambda o: made(OPTION, label=o["label"], text=o["text"], scoring=o["scoring"]))
    return made(ITEM, id=as_text(i["id"]), type=F.lit("vignette"), block=F.lit(2), text=i["scenario"], dimension=i["title"], options=options)


def layout() -> Column:
    """trait_mcq, flat, fc_pair or hybrid (with or without mcq items), by the blocks that a file has."""
    mcq, flat, pairs, hybrid = (F.col(c).isNotNull() for c in ("block_4_trait_mcq", "items", "block_fc_pairs", "block_3_likert"))
    return F.when(mcq & ~flat & ~hybrid, "trait_mcq").when(flat, "flat").when(pairs & ~hybrid, "fc_pair").when(mcq, "hybrid_mcq").otherwise("hybrid")


def read_questionnaires(spark: SparkSession, path: str) -> DataFrame:
    """(file, layout, and the blocks) of the JSON files at a path, one row each."""
    own = spark.read.schema(FILE).option("multiLine", True).json(path)
    return own.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).withColumn("layout", layout())


def items(files: DataFrame) -> DataFrame:
    """(file, layout, place, item fields) of all items, in the order in which they are asked; one call each."""
    some = lambda c, of: F.coalesce(F.transform(c, of), F.array().cast(f"array<{ITEM}>"))
    mixed = F.concat(some("block_1_forced_choice.pairs", choice_item), some("block_2_vignettes.scenarios", vignette_item), some("block_3_likert.items", likert_item), some("block_4_trait_mcq.items", mcq_item))
    every = F.when(F.col("layout") == "trait_mcq", some("block_4_trait_mcq.items", mcq_item)).when(F.col("layout") == "flat", some("items", likert_item)).when(F.col("layout") == "fc_pair", some("block_fc_pairs.items", pair_item)).otherwise(mixed)
    return files.select("file", "layout", F.posexplode(every).alias("place", "item")).select("file", "layout", "place", "item.*")


def columns(asked: DataFrame, blocks: list[str], align_signs: bool = True) -> DataFrame:
    """(file, place, column fields): the matrix columns of items whose block is wanted (likert, fc_pair, fc, vignette, trait_mcq).

    A flat questionnaire gives its columns whatever is wanted. A vignette has a column for each dimension that an option
    scores with more or less than 0; an option without scoring is an error. Pairs are coded +1 for the pole that is high,
    or for A if signs aren't aligned; the pole stays known as axis_high_letter.
    """
    wanted = lambda b: F.lit(b in blocks)
    text_at = lambda k: F.coalesce(F.get(F.filter("options", lambda o: o["label"] == k), F.lit(0))["text"], F.lit(""))
    both = F.concat(F.lit("A: "), text_at("A"), F.lit(" | B: "), text_at("B"))
    base = {"col_id": F.col("id"), "item_id": F.col("id")}
    likert = made(COLUMN, **base, block=F.lit("likert"), dimension=F.col("dimension"), text=F.col("text"), encoding=F.lit("1-5"), reverse_keyed=F.col("reverse_keyed"))
    pair = made(
        COLUMN, **base, block=F.lit("fc_pair"), dimension=F.col("dimension"), text=F.concat(F.lit("["), "dimension", F.lit("] "), "text", F.lit(" | "), both), encoding=F.lit("+1=high,-1=low" if align_signs else "+1=A,-1=B"),
        high_option=F.col("high_option") if align_signs else F.lit("A"), axis_high_letter=F.col("high_option"),
    )
    choice = made(COLUMN, **base, block=F.lit("fc"), text=both, encoding=F.lit("+1=A,-1=B"))
    mcq = made(COLUMN, **base, block=F.lit("trait_mcq"), dimension=F.col("dimension"), text=F.col("text"), encoding=F.when(F.col("layout") == "trait_mcq", "trait_aligned_0-1").otherwise("letter_1-4"))
    scored = F.flatten(F.transform("options", lambda o: F.map_keys(F.map_filter(o["scoring"], lambda _, v: v != 0))))
    bare = F.get(F.filter("options", lambda o: o["scoring"].isNull()), F.lit(0))
    told = F.raise_error(F.concat(F.lit("no scoring of an option of vignette "), "id", F.lit("/"), F.coalesce(bare["label"], F.lit("?")))).cast(f"array<{COLUMN}>")
    dims = F.transform(F.array_sort(F.array_distinct(scored)), lambda d: made(COLUMN, col_id=F.concat("id", F.lit("_"), d), item_id=F.col("id"), block=F.lit("vignette"), dimension=d, text=F.concat(F.lit("["), "dimension", F.lit("] → "), d), encoding=F.lit("option_score")))
    vignette = F.when(bare.isNotNull(), told).otherwise(dims)
    kind = F.col("type")
    each = (
        F.when((kind == "likert") & (wanted("likert") | (F.col("layout") == "flat")), F.array(likert)).when((kind == "fc_pair") & wanted("fc_pair"), F.array(pair)).when((kind == "forced_choice") & wanted("fc"), F.array(choice))
        .when((kind == "vignette") & wanted("vignette"), vignette).when((kind == "trait_mcq") & wanted("trait_mcq"), F.array(mcq))
    )
    return asked.select("file", "place", F.posexplode(each).alias("part", "c")).select("file", "place", "part", "c.*")
