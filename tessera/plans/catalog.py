"""Registered queries over the operators of this package, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import attributes as A
from tessera.functions import prompts as P
from tessera.functions import text as T
from tessera.operators import relational as R
from tessera.operators import similarity as S
from tessera.operators import suspects as U
from tessera.plans import refine, runs
from tessera.plans.oracle import ORACLE_SQL as RELATIONAL_SQL
from tessera.plans.views import view
from tessera.sources import files
from tessera.sources.shared import materialize, shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(runs.QUERIES)
ORACLE_SQL: dict[str, str] = RELATIONAL_SQL | runs.ORACLE


def query(f):
    QUERIES[f.__name__] = f
    return f


def over(name: str):
    """Registers a function of one view."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(view(spark, sf_dir, name))
        return f

    return register


# Projections and filters


@over("pairs_qi")
def project_common_fields(df):
    return R.project_common(df, "item_title")


@over("gens")
def falsy_coalesce(df):
    return df.select("id", T.falsy_coalesce(F.col("prompt_for_train"), F.col("prompt_for_desc"), F.col("id")).alias("value"))


@over("pairs_qi")
def dropna_subset(df):
    return R.project_common(df.na.drop(subset=["origin_query", "item_title", "label"]), "item_title")


@over("pairs_qi")
def label_isin(df):
    return R.valid_rows(df, "item_title").select("id", "label")


@over("pairs_qi")
def label_to_yesno(df):
    return df.select("id", P.label_to_yesno(F.col("label")).alias("output"))


@over("gens")
def response_to_pred(df):
    return df.select("id", P.response_to_pred(P.get_response(F.col("full_text"))).alias("prediction"))


@over("pairs_qc")
def positional_id(df):
    return R.positional_id(df.select("id", "line_no"), "line_no").select("id", "position")


@over("gens")
def filter_has_prompt(df):
    prompt = F.coalesce(T.falsy(F.col("prompt_for_train")), T.falsy(F.col("prompt_for_desc")))
    return df.where(prompt.isNotNull()).select("id", prompt.alias("prompt"))


@over("gens")
def limit_with_prompt(df):
    prompt = F.coalesce(T.falsy(F.col("prompt_for_train")), T.falsy(F.col("prompt_for_desc")))
    return df.where(prompt.isNotNull()).orderBy("line_no").limit(100).select("id", prompt.alias("prompt"))


@over("titles")
def tagged_or_raw(df):
    tagged = df.withColumn("item_title_tagged", F.when(F.length("id") % 2 == 0, A.attr_tag(F.col("item_title"), F.lit("x: y"))))
    return tagged.select("id", P.tagged_or_raw(tagged, "item_title").alias("title"))


def _bias(name: str, terms):
    def run(spark, sf_dir):
        both = None
        for v in ("titles", "pairs_qi"):
            df = view(spark, sf_dir, v)
            text = F.concat(T.normalize_text(F.col("origin_query")), F.lit(" || "), T.normalize_text(F.col("item_title")))
            part = df.select(F.lit(v).alias("view"), "id", U.any_term(text, terms).alias("hit"))
            both = part if both is None else both.unionAll(part)
        return both

    QUERIES[name] = run


_bias("bias_terms_fp", U.FP_TERMS)
_bias("bias_terms_fn", U.FN_TERMS)


# Text functions


@over("pairs_qi")
def normalize_text(df):
    return df.select("id", T.normalize_text(F.col("origin_query")).alias("q_norm"), T.normalize_text(F.col("item_title")).alias("i_norm"))


@over("pairs_qc")
def normalize_query(df):
    return df.select("id", T.normalize_query(F.col("origin_query")).alias("query"))


@over("pairs_qi")
def tokenize(df):
    tokens = T.tokenize(T.normalize_text(F.col("item_title")))
    return df.select("id", F.size(tokens).cast("long").alias("n_tokens"), F.array_join(tokens, "|").alias("tokens"))


@over("pairs_qi")
def jaccard(df):
    return S.add_pair_texts(df, "origin_query", "item_title").select("id", F.round("jac", 6).alias("jac"))


@over("pairs_qc")
def leaf_category(df):
    return df.select("id", T.leaf_category(F.col("category_path")).alias("leaf"))


@over("pairs_qc")
def category_depth_tags(df):
    return df.select("id", T.category_depth_tags(F.col("category_path")).alias("category_path"))


@over("pairs_qc")
def lang_tag(df):
    return df.select("id", T.lang_tag(F.col("language"), F.col("origin_query")).alias("origin_query"))


@over("pairs_qc")
def qc_tagging(df):
    tagged = df.withColumns({"origin_query": T.lang_tag(F.col("language"), F.col("origin_query")), "category_path": T.category_depth_tags(F.col("category_path"))})
    return tagged.drop("line_no")


# Attributes


@over("titles")
def extract_brand(df):
    return df.select("id", A.extract_brand(F.col("item_title")).alias("brand"))


@over("titles")
def extract_color(df):
    return df.select("id", A.extract_color(F.col("item_title")).alias("color"))


@over("titles")
def extract_size(df):
    return df.select("id", A.extract_size(F.col("item_title")).alias("size"))


@over("titles")
def extract_material(df):
    return df.select("id", A.extract_material(F.col("item_title")).alias("material"))


@over("titles")
def extract_category(df):
    return df.select("id", A.extract_category(F.col("item_title")).alias("category"))


@over("titles")
def extract_styles(df):
    return df.select("id", F.array_join(A.extract_styles(F.col("item_title")), "|").alias("styles"))


def _tagged(spark, sf_dir) -> DataFrame:
    """Titles with the leaf of their query's category path, attributes and their text."""
    lookup = R.query_leaf_map(view(spark, sf_dir, "pairs_qc"))
    df = R.add_query_leaf(view(spark, sf_dir, "titles"), lookup).withColumn("item_title", T.ustrip(F.col("item_title")))
    df = df.withColumn("a", A.attributes_struct(F.col("item_title"), F.col("qc_leaf")))
    return df.withColumn("attributes_str", A.attributes_str(F.col("a"), F.col("qc_leaf")))


@query
def attributes_struct(spark, sf_dir):
    a = [F.col(f"a.{k}").alias(k) for k in (*A.FIELDS,)]
    return _tagged(spark, sf_dir).select("id", *a, F.array_join("a.style_list", "|").alias("styles"))


@query
def attributes_str(spark, sf_dir):
    return _tagged(spark, sf_dir).select("id", "attributes_str")


@query
def attr_tag(spark, sf_dir):
    df = _tagged(spark, sf_dir)
    return df.select("id", A.attr_tag(F.col("item_title"), F.col("attributes_str")).alias("item_title_tagged"), T.ustrip(T.lang_tag(F.col("language"), F.col("origin_query"))).alias("origin_query_tagged"))


@query
def caption_prompt(spark, sf_dir):
    df = _tagged(spark, sf_dir)
    return df.select("id", P.caption_prompt(*[F.col(c) for c in ("origin_query", "item_title", "attributes_str", "language")]).alias("prompt_for_train"))


@query
def qc_map_build(spark, sf_dir):
    return R.query_leaf_map(view(spark, sf_dir, "pairs_qc"))


@query
def qc_leaf_lookup(spark, sf_dir):
    return R.add_query_leaf(view(spark, sf_dir, "titles"), R.query_leaf_map(view(spark, sf_dir, "pairs_qc"))).select("id", "qc_leaf")


# Prompts and generations


def _prompt(name: str):
    def run(spark, sf_dir):
        rows = P.icl_format(view(spark, sf_dir, "titles"), "QI").withColumn("options", F.when(F.length("input") % 2 == 0, F.col("options")))
        text = P.generate_prompt(F.col("instruction"), F.col("input"), F.col("options"), F.col("output"), name)
        return rows.groupBy(text.alias("prompt")).agg(F.count(F.lit(1)).alias("n"))

    QUERIES[f"prompt_{name}"] = run


_prompt("alpaca")
_prompt("mistral")


@over("gens")
def get_response(df):
    return df.select("id", P.get_response(F.col("full_text")).alias("response"))


@over("gens")
def parse_generation(df):
    return df.select("id", P.parse_generation(F.col("gen_text")).alias("g")).select("id", "g.*")


@over("titles")
def extract_query_line(df):
    text = F.concat(F.lit("Title\nQUERY:  "), F.col("origin_query"), F.lit(" \nquery: second\nProduct: "), F.col("item_title"))
    return df.select("id", T.line_value(text, "query").alias("value"))


@over("titles")
def extract_product_line(df):
    text = F.concat(F.lit("Query: "), F.col("origin_query"), F.lit("\nproduct: "), F.col("item_title"))
    return df.select("id", T.line_value(F.when(F.col("language") == "ko", F.col("origin_query")).otherwise(text), "product").alias("value"))


@over("pairs_qc")
def convert_qc_icl(df):
    return P.icl_format(df, "QC").groupBy("instruction", "input", "output", "options", "language").agg(F.count(F.lit(1)).alias("n"))


@over("titles")
def convert_qi_icl(df):
    return P.icl_format(df, "QI").groupBy("instruction", "input", "output", "options", "language").agg(F.count(F.lit(1)).alias("n"))


@over("pairs_qc")
def convert_qc_final(df):
    tagged = df.withColumns({"origin_query_tagged": T.lang_tag(F.col("language"), F.col("origin_query")), "category_path_tagged": F.when(F.col("category_path") != "", T.category_depth_tags(F.col("category_path")))})
    return P.final_format(tagged, "QC").groupBy("input", "output", "language", "gen_label").agg(F.count(F.lit(1)).alias("n"))


@query
def convert_qi_final(spark, sf_dir):
    gens = view(spark, sf_dir, "gens").select("id", P.parse_generation(F.col("gen_text")).alias("generation"))
    rows = view(spark, sf_dir, "titles").withColumnRenamed("label", "gold_label").join(gens, "id")
    return P.final_format(rows, "QI").groupBy("input", "output", "language", "gen_label").agg(F.count(F.lit(1)).alias("n"))


# Similarity


def _pairs(spark, sf_dir) -> DataFrame:
    return S.add_pair_texts(R.valid_rows(view(spark, sf_dir, "pairs_qi"), "item_title"), "origin_query", "item_title")


@query
def tfidf_corpus(spark, sf_dir):
    df = _pairs(spark, sf_dir)
    return df.select("id", F.lit("q").alias("side"), F.col("q_norm").alias("text")).unionAll(df.select("id", F.lit("i"), "i_norm"))


def _vocabulary(spark, sf_dir):
    pairs = materialize(_pairs(spark, sf_dir), "pair-texts")
    terms = materialize(S.pair_terms(pairs, "id"), "pair-terms")
    return terms, S.vocabulary(terms, S.corpus_size(pairs))


@query
def tfidf_vocab(spark, sf_dir):
    return _vocabulary(spark, sf_dir)[1].select("term", "df", F.round("idf", 6).alias("idf"))


@query
def tfidf_weights(spark, sf_dir):
    w = S.weights(*_vocabulary(spark, sf_dir))
    return w.groupBy(F.col("row_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(F.sqrt(F.sum(F.col("w_q") * F.col("w_q"))), 6).alias("q_length"),
        F.round(F.sqrt(F.sum(F.col("w_i") * F.col("w_i"))), 6).alias("i_length"),
    )


@query
def tfidf_cosine(spark, sf_dir):
    return S.add_cosine(materialize(_pairs(spark, sf_dir), "pair-texts"), "id").select("id", F.round("tfidf_cos", 6).alias("tfidf_cos"))


# Thresholds, predictions and suspects


def _titles(spark, sf_dir):
    return refine.similarities(view(spark, sf_dir, "titles"), "QI")


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query
def lang_quantiles(spark, sf_dir):
    return _rounded(U.quantiles(_titles(spark, sf_dir)), "q_hi_cos", "q_hi_jac", "q_lo_cos", "q_lo_jac")


@query
def lang_thresholds(spark, sf_dir):
    return _rounded(U.thresholds(_titles(spark, sf_dir)), *U.DEFAULTS)


@query
def lang_thresholds_fixed(spark, sf_dir):
    return U.thresholds(view(spark, sf_dir, "titles"), autotune=False)


@query
def threshold_lookup(spark, sf_dir):
    rows = view(spark, sf_dir, "titles")
    found = U.thresholds(_titles(spark, sf_dir)).where("language <> 'ko'")
    return _rounded(U.add_thresholds(rows, found).select("id", *U.DEFAULTS), *U.DEFAULTS)


@query
def pred_left_join(spark, sf_dir):
    rows = refine.join_predictions(view(spark, sf_dir, "pairs_qi"), view(spark, sf_dir, "preds"))
    return rows.select("id", "label", "pred", F.round("prob1", 6).alias("prob1"))


@query
def pred_disagree(spark, sf_dir):
    return refine.join_predictions(view(spark, sf_dir, "pairs_qi"), view(spark, sf_dir, "preds")).select("id", "disagree")


@over("preds")
def prob1_from_logits(df):
    return refine.predictions(df).select("id", F.round("prob1", 6).alias("prob1"))


@over("preds")
def prob_from_logprobs(df):
    return df.select("id", F.round(U.prob_from_logprobs(F.col("logit1"), F.col("logit0")), 6).alias("prob1"))


def _flagged(spark, sf_dir):
    return refine.flagged(view(spark, sf_dir, "pairs_qi"), view(spark, sf_dir, "preds"), "QI")


@query
def suspect_base(spark, sf_dir):
    rows = _titles(spark, sf_dir)
    return U.add_thresholds(rows, U.thresholds(rows)).select("id", U.base_suspect().alias("suspect"))


@query
def suspect_no_pred(spark, sf_dir):
    return refine.flagged(view(spark, sf_dir, "titles"), None, "QI").select("id", "suspect_no_pred")


@query
def suspect_with_pred(spark, sf_dir):
    return _flagged(spark, sf_dir).select("id", "suspect_no_pred", "suspect_with_pred")


@query
def suspect_report(spark, sf_dir):
    return U.report(_flagged(spark, sf_dir))


@query
def refine_pipeline_qi(spark, sf_dir):
    return refine.refine(view(spark, sf_dir, "pairs_qi"), view(spark, sf_dir, "preds"), "QI")


@query
def refined_output_qi(spark, sf_dir):
    return refine.refine(view(spark, sf_dir, "titles"), None, "QI")


@query
def refined_output_qc(spark, sf_dir):
    return refine.refine(view(spark, sf_dir, "pairs_qc"), None, "QC")


# Reports, splits, ids, masks


@over("pairs_qi")
def output_value_counts(df):
    return df.groupBy(P.label_to_yesno(F.col("label")).alias("output")).agg(F.count(F.lit(1)).alias("n"))


@query
def f1_score(spark, sf_dir):
    rows = view(spark, sf_dir, "pairs_qi").join(view(spark, sf_dir, "preds"), "id")
    return U.f1(rows).select(F.round("f1", 6).alias("f1"))


@query
def stage_counts(spark, sf_dir):
    rows = _flagged(spark, sf_dir)
    return rows.agg(F.count(F.lit(1)).alias("n_valid"), F.count_if(F.col("suspect_with_pred")).alias("n_suspect"), F.count_if(~F.col("suspect_with_pred")).alias("n_clean"))


@query
def resume_anti_join(spark, sf_dir):
    return R.not_done(view(spark, sf_dir, "pairs_qi"), view(spark, sf_dir, "preds")).select("id")


@over("titles")
def seeded_shuffle(df):
    return R.seeded_order(df, "id").select("id", "shuffle_key")


@over("pairs_qi")
def stratified_split(df):
    rows = df.withColumn("output", P.label_to_yesno(F.col("label")))
    return R.stratified_split(rows, "output").select("id", "output", "split")


def _token_lengths(df) -> DataFrame:
    """Token rows of a pair: ids are the lengths of its words, the query's words the prompt."""
    words = lambda c: F.transform(T.tokenize(T.normalize_text(F.col(c))), lambda w: F.length(w))
    rows = df.withColumns({"p": words("origin_query"), "i": words("item_title")})
    return rows.withColumn("input_ids", R.truncate_with_end(F.concat("p", "i"), 1024, 0))


@over("titles")
def mask_prompt_labels(df):
    rows = _token_lengths(df)
    labels = R.mask_prompt(F.col("input_ids"), F.size("p"))
    return rows.select("id", F.array_join(labels.cast("array<string>"), " ").alias("labels"), F.size(R.loss_ids(labels)).cast("long").alias("n_loss"))


@over("titles")
def token_total(df):
    return _token_lengths(df).agg(F.sum(F.size("input_ids")).alias("n_tokens"))


# Files: written to the shared folder, read back


@query
def scan_jsonl(spark, sf_dir):
    rows = view(spark, sf_dir, "gens")
    path = shared_path(spark, "jsonl")
    files.write_jsonl(rows, path)
    return files.read_jsonl(spark, path, rows.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "))


@query
def scan_json_array(spark, sf_dir):
    rows = view(spark, sf_dir, "gens").select("id", "gen_text", "prompt_for_train")
    path = shared_path(spark, "json-array")
    files.write_json_arrays(rows, path)
    return files.read_json_array(spark, path, "id string, gen_text string, prompt_for_train string")


@query
def lang_quantiles_by_rank(spark, sf_dir):
    return _rounded(U.quantiles_by_rank(_titles(spark, sf_dir)), "q_hi_cos", "q_hi_jac", "q_lo_cos", "q_lo_jac")
