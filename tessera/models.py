"""Model backends as protocols, run on partitions; a deterministic stub for tests.

No weights ship here: a backend is a factory that a task calls once, so weights load on the
executor that uses them (``tessera.backends`` has one on the transformers library). Everything
around the model stays native.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.prompts import parse_generation
from tessera.operators.relational import mask_prompt, truncate_with_end

# Sampling of captions and of answers, training, and the known base models.
CAPTION_SAMPLING = {"max_new_tokens": 256, "temperature": 0.2, "top_p": 0.9}
ANSWER_SAMPLING = {"max_new_tokens": 5, "temperature": 0.15, "top_p": 0.95}
MICRO_BATCH = 2
IGNORED = -100  # a label that no loss sees
_ATTENTION = ("q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "up_proj", "down_proj", "lm_head")
MODELS = {
    "Qwen2.5-14B": ("Qwen/Qwen2.5-14B-Instruct", _ATTENTION, "alpaca"),
    "Meta-Llama-3-8B": ("meta-llama/Meta-Llama-3-8B-Instruct", _ATTENTION, "alpaca"),
    "Llama-2-13B": ("meta-llama/Llama-2-13b-chat-hf", _ATTENTION, "alpaca"),
    "Llama-2-7B": ("meta-llama/Llama-2-7b-chat-hf", _ATTENTION, "alpaca"),
    "Mistral-7B": ("mistralai/Mistral-7B-Instruct-v0.2", _ATTENTION, "mistral"),
    "eCeLLM-S": ("NingLab/eCeLLM-S", ("Wqkv", "out_proj", "fc1", "fc2", "linear"), "alpaca"),
    "eCeLLM-M": ("NingLab/eCeLLM-M", _ATTENTION, "alpaca"),
    "eCeLLM-L": ("NingLab/eCeLLM-L", _ATTENTION, "alpaca"),
}


@dataclass(frozen=True)
class TrainingConfig:
    base_model: str
    lora_target_modules: tuple[str, ...]
    prompt_template: str = "alpaca"
    num_epochs: int = 2
    batch_size: int = 8
    micro_batch_size: int = 2
    cutoff_len: int = 1024
    learning_rate: float = 1e-4
    lora_r: int = 16
    lora_alpha: int = 16
    lora_dropout: float = 0.05
    lr_scheduler: str = "cosine"
    optimizer: str = "adamw_torch"
    warmup_ratio: float = 0.05
    seed: int = 42


def training_config(name: str, **changes) -> TrainingConfig:
    if name not in MODELS:
        raise ValueError(f"no model named {name}; there are {', '.join(MODELS)}")
    return TrainingConfig(*MODELS[name], **changes)


class Generator(Protocol):
    def generate(self, prompts: Sequence[str], **sampling) -> list[str]: ...


class Scorer(Protocol):
    def logprobs(self, prompts: Sequence[str], continuations: Sequence[str]) -> list[tuple[float, ...]]: ...


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...


class Trainer(Protocol):
    """See ``tessera.training``: figures come back as dicts, ``save`` returns the bytes it wrote."""

    def resume(self, path: str) -> None: ...

    def train(self, rows: DataFrame, config: TrainingConfig) -> dict: ...

    def save(self, path: str) -> int: ...

    def evaluate(self, rows: DataFrame) -> dict: ...


class Stub:
    """Answers from a hash of the prompt: stable, and wrong at random."""

    def generate(self, prompts: Sequence[str], **sampling) -> list[str]:
        return [f"[TAGS] x [/TAGS]\n[DESC] y [/DESC]\n[LABEL] {zlib.crc32(p.encode()) % 2} [/LABEL]" for p in prompts]

    def logprobs(self, prompts: Sequence[str], continuations: Sequence[str]) -> list[tuple[float, ...]]:
        score = lambda p, c: math.log((zlib.crc32((p + c).encode()) % 999 + 1) / 1000)
        return [tuple(score(p, c) for c in continuations) for p in prompts]

    def encode(self, text: str) -> list[int]:
        return [len(w) for w in text.split()]


def _mapped(df: DataFrame, factory: Callable, prompt: str, schema: str, answer: Callable, batch: int | None = None) -> DataFrame:
    """Adds the columns of ``schema`` that ``answer(model, prompts)`` gives, ``batch`` prompts at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            step = batch or max(1, len(pdf))
            for lo in range(0, len(pdf), step):
                model = model or factory()
                part = pdf.iloc[lo : lo + step].reset_index(drop=True)
                yield pd.concat([part, answer(model, part[prompt].tolist())], axis=1)

    names = [c.split()[0] for c in schema.split(", ")]
    fields = [f"`{n}` {t}" for n, t in df.dtypes if n not in names]
    return df.select(*[n for n in df.columns if n not in names]).mapInPandas(run, ", ".join([*fields, schema]))


def generate(df: DataFrame, factory: Callable[[], Generator], prompt: str = "prompt_for_train", batch: int | None = None, **sampling) -> DataFrame:
    """Adds ``text``, generated from each row's own prompt."""
    options = CAPTION_SAMPLING | sampling
    return _mapped(df, factory, prompt, "text string", lambda m, p: pd.DataFrame({"text": m.generate(p, **options)}), batch)


def caption(df: DataFrame, factory: Callable[[], Generator], limit: int = -1, order: str | None = None, batch: int | None = None, **sampling) -> DataFrame:
    """Rows with a prompt, their label as ``gold_label`` and the parsed generation."""
    prompt = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("prompt_for_train", "prompt_for_desc") if c in df.columns])
    rows = df.withColumn("prompt_for_train", prompt).where("prompt_for_train is not null")
    if limit >= 0:
        rows = (rows.orderBy(order) if order else rows).limit(limit)
    out = generate(rows.withColumnRenamed("label", "gold_label"), factory, batch=batch, **sampling)
    return out.withColumn("generation", parse_generation(F.col("text"))).drop("text", "prompt_for_desc")


def score(df: DataFrame, factory: Callable[[], Scorer], prompt: str = "prompt", batch: int | None = None) -> DataFrame:
    """Adds ``logprob_yes, logprob_no`` of the two answers after each prompt."""

    def answer(model: Scorer, prompts: list[str]) -> pd.DataFrame:
        return pd.DataFrame(model.logprobs(prompts, ("yes", "no")), columns=["logprob_yes", "logprob_no"])

    return _mapped(df, factory, prompt, "logprob_yes double, logprob_no double", answer, batch)


def training_rows(df: DataFrame, factory: Callable[[], Tokenizer], prompt: str, full: str, cutoff: int = 1024, end_id: int = 0) -> DataFrame:
    """Adds ``input_ids, attention_mask, labels``: the full text's ids, the prompt's masked.

    Only the tokenizer runs in Python; cutting, the end id and the mask are native.
    """

    def answer(model: Tokenizer, prompts: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"p": [len(model.encode(p)) for p in prompts]})

    def ids(model: Tokenizer, texts: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"ids": [model.encode(t) for t in texts]})

    rows = _mapped(_mapped(df, factory, prompt, "p int", answer), factory, full, "ids array<int>", ids)
    rows = rows.withColumn("input_ids", truncate_with_end(F.col("ids"), cutoff, end_id))
    labels = mask_prompt(F.col("input_ids"), F.least("p", F.lit(cutoff)))
    return rows.withColumns({"attention_mask": F.transform("input_ids", lambda _: F.lit(1)), "labels": labels}).drop("p", "ids")
