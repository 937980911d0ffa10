"""Registered queries over files, model runs and training, with their SQL twins.

Model backends here are arithmetic, so that SQL can say what they answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import cli, models, training
from tessera.functions import prompts as P
from tessera.operators import relational as R
from tessera.plans.oracle import GENERATION, ORACLE_SQL, over, yesno
from tessera.plans.views import view
from tessera.sources import files
from tessera.sources.shared import shared_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


class Echo:
    """Generates its prompts, scores lengths, and takes the letters of a word for its id."""

    def generate(self, prompts: Sequence[str], **sampling) -> list[str]:
        if len(prompts) > models.MICRO_BATCH:
            raise ValueError("more prompts than a micro-batch")
        return list(prompts)

    def logprobs(self, prompts: Sequence[str], continuations: Sequence[str]) -> list[tuple[float, ...]]:
        return [tuple(-((len(p) * (i + 3)) % 13) / 4 for i in range(len(continuations))) for p in prompts]

    def encode(self, text: str) -> list[int]:
        return [len(w) for w in text.split()]


def _gens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "gens")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


# Files


@query(over("gens", "SELECT * FROM gens"))
def scan_strict(spark, sf_dir):
    rows, path = _gens(spark, sf_dir), shared_path(spark, "strict")
    files.write_jsonl(rows, path)
    return files.read_jsonl(spark, path, _schema(rows), strict=True)


@query(over("gens", "SELECT id, prompt_for_train FROM (SELECT * FROM gens WHERE prompt_for_train <> '' ORDER BY line_no LIMIT 50) AS s"))
def scan_limit(spark, sf_dir):
    """Lines in file order over several files, blank ones between them."""
    path = shared_path(spark, "lines")
    lines = F.explode(F.array(F.to_json(F.struct("id", "prompt_for_train")), F.lit(" ")))
    _gens(spark, sf_dir).repartitionByRange(4, "line_no").sortWithinPartitions("line_no").select(lines).write.text(path)
    rows = files.read_jsonl(spark, path, "id string, prompt_for_train string", order="line_no")
    return rows.where("prompt_for_train <> ''").orderBy("line_no").limit(50).select("id", "prompt_for_train")


@query(over("titles", "SELECT id, CAST(NULL AS VARCHAR) AS qc_leaf FROM titles"))
def missing_source(spark, sf_dir):
    qc = files.read_optional_jsonl(spark, shared_path(spark, "missing"), files.SCHEMAS["QC"], order="line_no")
    return R.add_query_leaf(view(spark, sf_dir, "titles"), R.query_leaf_map(qc)).select("id", "qc_leaf")


@query(over("gens", "SELECT * FROM gens"))
def append_jsonl(spark, sf_dir):
    rows, path = _gens(spark, sf_dir), shared_path(spark, "appended")
    half = F.col("line_no") % 2 == 0
    files.write_jsonl(rows.where(half), path)
    files.write_jsonl(rows.where(~half), path, append=True)
    return files.read_jsonl(spark, path, _schema(rows))


@query(over("preds", "SELECT id FROM preds WHERE CAST(id AS BIGINT) % 3 <> 0"))
def resume_torn(spark, sf_dir):
    """What is left to do behind an output whose last lines are torn."""
    path = shared_path(spark, "torn")
    preds = view(spark, sf_dir, "preds").select("id", "prediction")
    done, torn = F.to_json(F.struct("id", "prediction")), F.concat(F.lit('{"id":"'), F.col("id"))
    preds.select(F.when(F.col("id") % 3 == 0, done).otherwise(torn)).write.text(path)
    found = files.read_optional_jsonl(spark, path, files.SCHEMAS["predictions"], tolerant=True).where("prediction is not null")
    return R.not_done(preds.select("id"), found)


@query(over("titles", """SELECT id, CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN 'unk' ELSE language END AS language,
  CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN origin_query ELSE item_title END AS text FROM titles"""))  # fmt: skip
def key_fallback(spark, sf_dir):
    """A null value is not a missing key: every third language is null and doesn't fall back."""
    n = F.col("id").cast("long")
    language = F.when(n % 3 == 0, F.lit("null")).otherwise(F.to_json(F.struct("language")).substr(F.lit(13), F.length("language") + 2))
    named = F.when(n % 3 == 1, F.concat(F.lit('"lang":'), language)).otherwise(F.concat(F.lit('"language":'), language, F.lit(',"lang":"xx"')))
    short = F.to_json(F.when(n % 2 == 0, F.named_struct(F.lit("origin_query"), F.col("origin_query"), F.lit("q"), F.lit("no"))))
    long = F.to_json(F.when(n % 2 == 1, F.named_struct(F.lit("q"), F.col("item_title"))))
    raw = F.concat(F.lit("{"), named, F.lit(","), F.coalesce(short, long).substr(F.lit(2), F.lit(1 << 20)))
    rows = view(spark, sf_dir, "titles").select("id", raw.alias("raw"))
    pick = lambda a, b, default: files.present_or(F.col("raw"), a, b, default)
    return rows.select("id", pick("language", "lang", "unk").alias("language"), pick("origin_query", "q", "").alias("text"))


@query(f"SELECT output, split, count(*) AS n FROM ({ORACLE_SQL['stratified_split']}) AS s GROUP BY ALL")
def split_report(spark, sf_dir):
    rows = view(spark, sf_dir, "pairs_qi").withColumn("output", P.label_to_yesno(F.col("label")))
    return R.stratified_split(rows, "output").groupBy("output", "split").agg(F.count(F.lit(1)).alias("n"))


# Model runs


@query(over("gens", 'SELECT id, \'1\' AS gold_label, tags_block, "desc", pred_label, tags_block IS NOT NULL AND "desc" IS NOT NULL AND pred_label IS NOT NULL AS is_valid FROM parsed WHERE gen_text <> \'\'', GENERATION.replace("SELECT id,", "SELECT id, gen_text,", 1)))
def caption_run(spark, sf_dir):
    """Captions in micro-batches, each answer beside its own row."""
    rows = _gens(spark, sf_dir).select("id", F.col("gen_text").alias("prompt_for_train"), F.lit("1").alias("label"))
    out = models.caption(rows, Echo, batch=models.MICRO_BATCH)
    return out.select("id", "gold_label", *[F.col(f"generation.{c}").alias(c) for c in ("tags_block", "desc", "pred_label", "is_valid")])


_YES, _NO = "(-((length(full_text) * 3) % 13) / 4.0)", "(-((length(full_text) * 4) % 13) / 4.0)"


@query(over("gens", f"""SELECT id, CASE WHEN lower(trim(split_part(full_text, '### Response:', 2), ' ' || chr(10))) = 'yes' THEN 1 ELSE 0 END AS prediction,
  round(exp({_YES} - greatest({_YES}, {_NO})) / (exp({_YES} - greatest({_YES}, {_NO})) + exp({_NO} - greatest({_YES}, {_NO}))), 6)::DOUBLE AS prob1,
  round({_YES}, 3)::DOUBLE AS logprob_yes, round({_NO}, 3)::DOUBLE AS logprob_no FROM gens"""))  # fmt: skip
def predict_run(spark, sf_dir):
    """Answers and scores in micro-batches, rounded as the output has them."""
    rows = _gens(spark, sf_dir).select("id", F.col("full_text").alias("prompt"))
    out = models.generate(rows, Echo, "prompt", models.MICRO_BATCH, **models.ANSWER_SAMPLING)
    return cli.rounded(models.score(cli.answered(out, "alpaca"), Echo, batch=models.MICRO_BATCH))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{b}', '{t}', {len(m)})" for n, (b, m, t) in models.MODELS.items()) + ") AS m(name, base_model, template, n_modules)")
def model_registry(spark, sf_dir):
    found = [models.training_config(n) for n in models.MODELS]
    return spark.createDataFrame([(n, c.base_model, c.prompt_template, len(c.lora_target_modules)) for n, c in zip(models.MODELS, found)], "name string, base_model string, template string, n_modules int")


# Training

CUTOFF = 12
_WORDS = "[length(w)::INT FOR w IN regexp_extract_all({}, '[^\\s]+')]"
TOKENS = f"""cut AS (SELECT id, label, len({_WORDS.format("origin_query")}) AS p, {_WORDS.format("origin_query || ' ' || item_title")}[:{CUTOFF}] AS x FROM titles),
tokens AS (SELECT id, label, least(p, {CUTOFF}) AS p, CASE WHEN len(x) < {CUTOFF} AND coalesce(x[-1], 1) <> 0 THEN list_append(x, 0) ELSE x END AS ids FROM cut),
masked AS (SELECT *, list_concat([-100 FOR t IN ids[:least(p, len(ids))]], ids[least(p, len(ids)) + 1:]) AS labels FROM tokens)"""


def _token_rows(spark, sf_dir) -> DataFrame:
    rows = view(spark, sf_dir, "titles").withColumn("full", F.concat("origin_query", F.lit(" "), "item_title"))
    return models.training_rows(rows, Echo, "origin_query", "full", CUTOFF, 0)


def _text(name: str):
    return F.array_join(F.col(name).cast("array<string>"), " ").alias(name)


@query(over("titles", "SELECT id, array_to_string(ids, ' ') AS input_ids, array_to_string([1 FOR t IN ids], ' ') AS attention_mask, array_to_string(labels, ' ') AS labels FROM masked", TOKENS))
def tokenize_truncate(spark, sf_dir):
    return _token_rows(spark, sf_dir).select("id", _text("input_ids"), _text("attention_mask"), _text("labels"))


@query(over("titles", """SELECT id, batch, array_to_string(list_concat(ids, [0 FOR i IN range(n - len(ids))]), ' ') AS input_ids, array_to_string(list_concat([1 FOR t IN ids], [0 FOR i IN range(n - len(ids))]), ' ') AS attention_mask,
  array_to_string(list_concat(labels, [-100 FOR i IN range(n - len(ids))]), ' ') AS labels
  FROM (SELECT *, (max(len(ids)) OVER (PARTITION BY batch) + 7) // 8 * 8 AS n FROM (SELECT *, (row_number() OVER (ORDER BY (CAST(id AS BIGINT) + 42) * 2654435761 % 4294967296, id) - 1) // 4 AS batch FROM masked) AS s) AS s""", TOKENS))  # fmt: skip
def collate_batches(spark, sf_dir):
    out = training.collated(_token_rows(spark, sf_dir), 4)
    return out.select("id", "batch", _text("input_ids"), _text("attention_mask"), _text("labels"))


_COUNTS = f"""{TOKENS},
seen AS (SELECT t AS token, 2 * count(*) AS n FROM (SELECT unnest([x FOR x IN labels IF x <> -100]) AS t FROM masked WHERE label = '0') AS s GROUP BY 1),
asked AS (SELECT t AS token, count(*) AS times FROM (SELECT unnest([x FOR x IN labels IF x <> -100]) AS t FROM masked WHERE label = '1') AS s GROUP BY 1)"""


def _trained(spark, rows, resume: str | None = None) -> training.CountTrainer:
    trainer = training.CountTrainer(spark)
    if resume:
        trainer.resume(resume)
    trainer.train(training.collated(rows, 4), models.training_config("eCeLLM-M"))
    return trainer


@query(over("titles", "SELECT round(sum(times * ln((total + kinds + 1) / (coalesce(n, 0) + 1))) / sum(times), 6) AS eval_loss FROM asked LEFT JOIN seen USING (token), (SELECT sum(n) AS total, count(*) AS kinds FROM seen) AS z", _COUNTS))
def eval_loss(spark, sf_dir):
    rows = _token_rows(spark, sf_dir)
    return _trained(spark, rows.where("label = '0'")).losses(rows.where("label = '1'")).select(F.round("eval_loss", 6).alias("eval_loss"))


@query(over("titles", "SELECT t AS token, 2 * count(*) AS n FROM (SELECT unnest([x FOR x IN labels IF x <> -100]) AS t FROM masked) AS s GROUP BY 1", TOKENS))
def train_resume(spark, sf_dir):
    """Trained on one half, saved, resumed and trained on the other."""
    rows, path = _token_rows(spark, sf_dir), shared_path(spark, "checkpoint")
    _trained(spark, rows.where("label = '0'")).save(path)
    return _trained(spark, rows.where("label = '1'"), path).counts.select("token", "n")


_PROMPT = "'" + (P.template("alpaca")["before"] + "### Instruction:\n").replace("'", "''") + "' || 'match' || chr(10) || chr(10) || '### Input:' || chr(10) || item_title || chr(10) || chr(10) || '" + P.template("alpaca")["after"].replace("'", "''") + "'"


@query(f"""WITH split AS ({ORACLE_SQL['stratified_split']}), rows AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, d.text AS item_title, {yesno("CAST(l.quality AS VARCHAR)")} AS answer FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
sized AS (SELECT least(64, len(regexp_extract_all({_PROMPT} || answer, '[^\\s]+')) + 1) AS n FROM rows JOIN split USING (id) WHERE split = 'train')
SELECT sum(n)::DOUBLE / 1000 AS num_tokens_k, 64::BIGINT AS cutoff_len FROM sized""")  # fmt: skip
def train_summary(spark, sf_dir):
    """A whole training run; figures of the summary that it wrote beside the model."""
    rows = view(spark, sf_dir, "pairs_qi").select("id", F.lit("match").alias("instruction"), F.col("item_title").alias("input"), F.lit(None).cast("string").alias("options"), P.label_to_yesno(F.col("label")).alias("output"))
    path = shared_path(spark, "model")
    training.train(rows, training.CountTrainer(spark), Echo, models.training_config("eCeLLM-M", cutoff_len=64), path)
    written = spark.read.option("multiLine", True).json(f"{path}/training_summary.json")
    return written.select("num_tokens_k", F.col("params.cutoff_len").alias("cutoff_len"))
