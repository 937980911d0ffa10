"""Command line of the engine: ``python -m tessera.cli <command> --input … --output …``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import models, training
from tessera.functions import attributes as A
from tessera.functions import prompts as P
from tessera.functions import text as T
from tessera.operators import relational as R
from tessera.operators import suspects as U
from tessera.plans import refine
from tessera.sources import files


def read_pairs(spark: SparkSession, path: str, task: str) -> DataFrame:
    """Raw rows of a task with the short names as fallbacks, and a unique ``row_id``.

    A missing key falls back, a null value doesn't.
    """
    raw = files.read_lines(spark, path, "_line")
    at = lambda k: F.get_json_object("value", f"$.{k}")
    item = refine.item_column(task)
    has = lambda k: files.key_present(F.col("value"), k)
    language = F.when(has("language"), at("language")).otherwise(F.lit("unk"))
    title = F.when(has(item), at(item)).otherwise(F.lit(""))
    given = F.when(has("query"), at("query")).otherwise(F.lit(""))
    return raw.select(
        F.col("_line.n").alias("row_id"), at("id").alias("id"), language.alias("language"),
        F.coalesce(T.falsy(at("origin_query")), given).alias("origin_query"), title.alias(item), at("label").alias("label"), "value",
    )


def clean(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    preds = files.read_optional_jsonl(spark, o.pred, files.SCHEMAS["predictions"]) if o.pred else None
    flagged = refine.flagged(read_pairs(spark, o.input, o.task), preds, o.task, not o.no_autotune, row_id="row_id").persist()
    try:
        U.report(flagged).orderBy("label").show()
        out = R.project_common(flagged.where(~F.col("suspect_with_pred")), refine.item_column(o.task))
        files.write_jsonl(out, o.output)
    finally:
        flagged.unpersist()
    return out


def icl(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    task = "QC" if "qc" in o.run else "QI"
    out = P.icl_format(files.read_jsonl(spark, o.input, files.SCHEMAS[task]), task, o.has_label)
    files.write_json_arrays(out, o.output, 4)
    return out


def tag_qc(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    rows = spark.read.json(o.input)
    out = rows.withColumns({"origin_query": T.lang_tag(F.col("language"), F.col("origin_query")), "category_path": T.category_depth_tags(F.col("category_path"))})
    files.write_jsonl(out, o.output)
    return out


def tag_qi(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    raw = files.read_lines(spark, o.input, "_line")
    value, at = F.col("value"), lambda k: F.get_json_object("value", f"$.{k}")
    rows = raw.select(
        at("id").alias("id"), F.coalesce(at("task"), F.lit("QI")).alias("task"),
        T.ustrip(files.present_or(value, "language", "lang", "unk")).alias("language"),
        files.present_or(value, "origin_query", "q", "").alias("origin_query"),
        T.ustrip(files.present_or(value, "item_title", "i", "")).alias("item_title"), at("label").alias("label"),
    )
    qc = files.read_optional_jsonl(spark, o.qc_path, files.SCHEMAS["QC"], order="line_no")
    rows = R.add_query_leaf(rows, R.query_leaf_map(qc))
    rows = rows.withColumn("attributes_extracted", A.attributes_struct(F.col("item_title"), F.col("qc_leaf")))
    rows = rows.withColumn("attributes_str", A.attributes_str(F.col("attributes_extracted"), F.col("qc_leaf")))
    out = rows.withColumns(
        {
            "origin_query_tagged": T.ustrip(T.lang_tag(F.col("language"), F.col("origin_query"))),
            "item_title_tagged": A.attr_tag(F.col("item_title"), F.col("attributes_str")),
            "prompt_for_train": P.caption_prompt(*[F.col(c) for c in ("origin_query", "item_title", "attributes_str", "language")]),
        }
    ).drop("qc_leaf")
    files.write_jsonl(out, o.output)
    return out


def caption(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    rows = files.read_jsonl(spark, o.input, order="line_no")
    factory = _backend(o.backend)
    out = models.caption(rows, factory, o.limit, "line_no", o.batch_size, max_new_tokens=o.max_new_tokens, temperature=o.temperature, top_p=o.top_p).drop("line_no")
    files.write_jsonl(out, o.output)
    return out


def convert(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    out = P.final_format(spark.read.json(o.input), o.task, o.split)
    files.write_json_arrays(out, o.output, 2)
    return out


def read_instructions(spark: SparkSession, path: str, template: str) -> DataFrame:
    """Instruction rows with ``id`` (their own, or else the position in file order) and ``prompt``."""
    rows = files.read_json_array(spark, path, order="_line")
    if "options" not in rows.columns:
        rows = rows.withColumn("options", F.lit(None).cast("string"))
    if "id" not in rows.columns:
        rows = with_position(rows).withColumnRenamed("position", "id")
    prompt = P.generate_prompt(F.col("instruction"), F.col("input"), F.col("options"), None, template)
    return rows.withColumns({"id": F.col("id").cast("string"), "prompt": prompt}).drop("_line")


def with_position(rows: DataFrame) -> DataFrame:
    """``position`` from 1 in file order; ``_line`` says where a row stands."""
    placed = R.positional_id(rows.select("_line"), "_line").select(F.col("_line").alias("_at"), "position")
    return rows.join(placed, rows["_line"] == placed["_at"]).drop("_line", "_at")


def answered(rows: DataFrame, template: str) -> DataFrame:
    """``text`` without the prompt, where a backend gives it back whole."""
    text = F.col("text")
    whole = F.contains(text, F.lit(P.template(template)["split"]))
    return rows.withColumn("text", F.when(whole, P.get_response(text, template)).otherwise(text))


def rounded(scored: DataFrame, scores: bool = True) -> DataFrame:
    """``id, prediction, prob1, logprob_yes, logprob_no`` of answers and their scores, rounded."""
    out = [F.col("id"), P.response_to_pred(F.col("text")).alias("prediction")]
    if scores:
        prob = U.prob_from_logprobs(F.col("logprob_yes"), F.col("logprob_no"))
        out += [F.round(prob, 6).alias("prob1"), F.round("logprob_yes", 3).alias("logprob_yes"), F.round("logprob_no", 3).alias("logprob_no")]
    return scored.select(*out)


def predict(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    """Answers instruction rows and appends what isn't in the output yet, by the row's own id.

    A line that an earlier run left torn is no prediction: its row is answered again.
    """
    rows = read_instructions(spark, o.input, o.template)
    done = files.read_optional_jsonl(spark, o.output, files.SCHEMAS["predictions"], tolerant=True).where("id is not null and prediction is not null")
    left = R.not_done(rows.select("id", "prompt"), done)
    factory = _backend(o.backend)
    sampling = {"max_new_tokens": o.max_new_tokens, "temperature": o.temperature, "top_p": o.top_p}
    out = models.generate(left, factory, "prompt", o.batch_size, **sampling)
    out = answered(out, o.template)
    if o.save_scores:
        out = models.score(out, factory, batch=o.batch_size)
    out = rounded(out, o.save_scores)
    files.write_jsonl(out, o.output, append=True)
    return out


def split(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    rows = with_position(files.read_json_array(spark, o.input, order="_line"))
    out = R.stratified_split(rows, "output", "position", o.test_share, o.seed)
    files.write_jsonl(out, o.output)
    out.groupBy("split", "output").count().orderBy("split", "output").show()
    return out


def train(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    """Trains on instruction rows; ``--backend counts`` needs no library, ``lora`` the optional ones."""
    changes = {"num_epochs": o.num_epochs, "cutoff_len": o.cutoff_len, "learning_rate": o.learning_rate, "batch_size": o.batch_size, "micro_batch_size": o.micro_batch_size}
    config = models.training_config(o.model, **changes)
    rows = read_instructions(spark, o.input, config.prompt_template).drop("prompt")
    rows.groupBy("output").count().orderBy(F.desc("count")).show()
    if o.backend == "lora":
        from tessera.backends import LoraTrainer

        trainer = LoraTrainer(spark, config, o.output)
    else:
        trainer = training.CountTrainer(spark)
    figures = training.train(rows, trainer, _backend(o.tokenizer), config, o.output, o.resume_from_checkpoint, o.test_share)
    return files.summary(spark, **figures)


def _backend(name: str):
    """``module:factory``, or the stub."""
    if name == "stub":
        return models.Stub
    import importlib

    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, f, *paths: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("--input", "--input_path", dest="input", required=True)
        p.add_argument("--output", "--output_path", dest="output", required=True)
        p.set_defaults(f=f)
        return p

    p = command("clean", clean)
    p.add_argument("--task", required=True, choices=["QI", "QC", "qi", "qc"])
    p.add_argument("--pred")
    p.add_argument("--no_autotune", action="store_true")
    p = command("icl", icl)
    p.add_argument("--run", required=True, choices=["convert_qi_format_with_icl", "convert_qc_format_with_icl"])
    p.add_argument("--has_label", action=argparse.BooleanOptionalAction, default=True)
    command("tag-qc", tag_qc)
    command("tag-qi", tag_qi).add_argument("--qc_path")
    p = command("caption", caption)
    p.add_argument("--limit", type=int, default=-1)
    p.add_argument("--max_new_tokens", type=int, default=models.CAPTION_SAMPLING["max_new_tokens"])
    p.add_argument("--temperature", type=float, default=models.CAPTION_SAMPLING["temperature"])
    p.add_argument("--top_p", type=float, default=models.CAPTION_SAMPLING["top_p"])
    p.add_argument("--batch_size", type=int, default=models.MICRO_BATCH)
    p.add_argument("--backend", default="stub")
    p = command("convert", convert)
    p.add_argument("--task", required=True, choices=["QI", "QC", "qi", "qc"])
    p.add_argument("--split", choices=["train", "test"], default="train")
    p = command("predict", predict)
    p.add_argument("--template", "--prompt_template", dest="template", default="alpaca")
    p.add_argument("--max_new_tokens", type=int, default=models.ANSWER_SAMPLING["max_new_tokens"])
    p.add_argument("--temperature", type=float, default=models.ANSWER_SAMPLING["temperature"])
    p.add_argument("--top_p", type=float, default=models.ANSWER_SAMPLING["top_p"])
    p.add_argument("--batch_size", type=int, default=models.MICRO_BATCH)
    p.add_argument("--save_scores", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--backend", default="stub")
    p = command("train", train)
    config = models.TrainingConfig("", ())
    p.add_argument("--model", default="eCeLLM-M", choices=list(models.MODELS))
    p.add_argument("--backend", default="counts", choices=["counts", "lora"])
    p.add_argument("--tokenizer", default="stub")
    p.add_argument("--resume_from_checkpoint")
    p.add_argument("--test_share", type=float, default=0.2)
    for name in ("num_epochs", "cutoff_len", "batch_size", "micro_batch_size"):
        p.add_argument(f"--{name}", type=int, default=getattr(config, name))
    p.add_argument("--learning_rate", type=float, default=config.learning_rate)
    p = command("split", split)
    p.add_argument("--test_share", type=float, default=0.2)
    p.add_argument("--seed", type=int, default=42)
    return top


def main(argv: list[str] | None = None) -> None:
    options = parser().parse_args(argv)
    options.f(SparkSession.builder.getOrCreate(), options)


if __name__ == "__main__":
    main()
