"""Fine-tuning around a trainer backend: split, token rows, batches, resume, evaluation, summary.

Everything but the gradient is Spark: a backend gets token rows as a DataFrame (``input_ids``,
``attention_mask``, ``labels``, in shuffled order and in batches) and returns figures.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.prompts import generate_prompt
from tessera.models import IGNORED, Tokenizer, Trainer, TrainingConfig, training_rows
from tessera.operators.relational import loss_ids, pad_to, portable_hash, positional_id, stratified_split
from tessera.sources.files import write_text
from tessera.sources.shared import materialize

END_ID, PAD_ID = 0, 0


def collated(rows: DataFrame, batch_size: int, key: str = "id", seed: int = 42, pad_id: int = PAD_ID, multiple: int = 8) -> DataFrame:
    """Adds ``batch`` and pads each row to its batch's longest, rounded up to a multiple.

    Rows are shuffled by a seeded hash of their key and dealt to batches in that order. Ids are
    padded on the right, the mask by 0, labels by the ignored id.
    """
    order = positional_id(rows.select(portable_hash(F.col(key), seed).alias("_h"), F.col(key).alias("_k")), "_h", "_k")
    placed = rows.join(order, rows[key] == order["_k"]).withColumn("batch", F.expr(f"(position - 1) div {int(batch_size)}")).drop("_h", "_k", "position")
    longest = placed.groupBy(F.col("batch").alias("_b")).agg(F.max(F.size("input_ids")).alias("_n"))
    wide = placed.join(longest, placed["batch"] == longest["_b"])
    length = (F.ceil(F.col("_n") / multiple) * multiple).cast("int")
    fills = {"input_ids": pad_id, "attention_mask": 0, "labels": IGNORED}
    return wide.withColumns({c: pad_to(F.col(c), length, v) for c, v in fills.items()}).drop("_b", "_n")


def token_total(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.size("input_ids"))).first()[0] or 0


def prepared(rows: DataFrame, tokenizer: Callable[[], Tokenizer], config: TrainingConfig, test_share: float = 0.2) -> DataFrame:
    """Instruction rows (``id, instruction, input, options, output``) as token rows with ``split``."""
    template = config.prompt_template
    part = [F.col("instruction"), F.col("input"), F.col("options")]
    prompted = rows.withColumns({"_prompt": generate_prompt(*part, None, template), "_full": generate_prompt(*part, F.col("output"), template)})
    divided = stratified_split(prompted, "output", "id", test_share, config.seed)
    return training_rows(divided, tokenizer, "_prompt", "_full", config.cutoff_len, END_ID).drop("_prompt", "_full")


def train(rows: DataFrame, trainer: Trainer, tokenizer: Callable[[], Tokenizer], config: TrainingConfig, output: str, resume: str | None = None, test_share: float = 0.2) -> dict:
    """Trains on the larger part of the rows, saves, evaluates on the held-out part.

    ``resume``: a folder that the trainer saved before. Writes ``training_summary.json`` beside the
    model and returns it.
    """
    tokens = materialize(prepared(rows, tokenizer, config, test_share), "token-rows")
    fit, held_out = (tokens.where(F.col("split") == s) for s in ("train", "test"))
    if resume:
        trainer.resume(resume)
    start = time.monotonic()
    figures = trainer.train(collated(fit, config.micro_batch_size, seed=config.seed), config)
    seconds = time.monotonic() - start
    size = trainer.save(output)
    sample = fit.orderBy("id").select("input_ids", "attention_mask", "labels").first()
    summary = {
        "params": asdict(config), "sample": sample.asDict() if sample else None, "num_tokens_k": token_total(fit) / 1000,
        "training_time_sec": seconds, "training_time_hr": seconds / 3600, "model_size_MB": size / 2**20,
        "peak_memory_MB": figures.pop("peak_memory_MB", None), **figures, **trainer.evaluate(held_out),
    }
    write_text(rows.sparkSession, f"{output.rstrip('/')}/training_summary.json", json.dumps(summary, ensure_ascii=False, indent=4))
    return summary


class CountTrainer:
    """A unigram model over the loss positions, by counts: the smallest trainer there is.

    ``eval_loss`` is the mean negative log probability of the held-out loss ids, with one added to
    each count and one id for all that are unknown. Counts are a table, so any number of ids will do.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.counts = spark.createDataFrame([], "token int, n long")

    def resume(self, path: str) -> None:
        self.counts = self.spark.read.parquet(f"{path.rstrip('/')}/counts")

    def train(self, rows: DataFrame, config: TrainingConfig) -> dict:
        new = rows.select(F.explode(loss_ids(F.col("labels"))).alias("token")).groupBy("token").agg((F.count(F.lit(1)) * config.num_epochs).alias("n"))
        self.counts = materialize(self.counts.unionAll(new).groupBy("token").agg(F.sum("n").alias("n")), "counts")
        return {"loss_tokens": self.counts.agg(F.sum("n")).first()[0] or 0}

    def save(self, path: str) -> int:
        """Returns the bytes that the counts take."""
        self.counts.write.mode("overwrite").parquet(f"{path.rstrip('/')}/counts")
        return 12 * self.counts.count()

    def losses(self, rows: DataFrame) -> DataFrame:
        """One row: ``eval_loss`` over ``rows(labels)``; null without any."""
        size = self.counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("kinds"))
        asked = rows.select(F.explode(loss_ids(F.col("labels"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("times"))
        known = asked.join(self.counts, "token", "left").crossJoin(F.broadcast(size))
        each = F.log((F.col("total") + F.col("kinds") + 1) / (F.coalesce("n", F.lit(0)) + 1))
        return known.agg((F.sum(F.col("times") * each) / F.sum("times")).alias("eval_loss"))

    def evaluate(self, rows: DataFrame) -> dict:
        return {"eval_loss": self.losses(rows).first()[0]}
