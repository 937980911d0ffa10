"""The SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from tessera.functions import attributes as A
from tessera.functions import prompts as P
from tessera.functions.text import KEPT
from tessera.operators import suspects as U
from tessera.plans.views import VIEWS

CLASS = rf"[^{KEPT}\s/.\-:]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), {lit(CLASS)}, ' ', 'g'), '\\s+', ' ', 'g'))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def norm_query(c: str) -> str:
    return f"regexp_replace({strip(f'lower(coalesce({c}, {lit("")}))')}, '\\s+', ' ', 'g')"


def tokens(c: str) -> str:
    return f"[t FOR t IN string_split({c}, ' ') IF t <> '']"


def jac(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / greatest(1, len(list_distinct(list_concat({a}, {b}))))::DOUBLE)"


def segments(c: str) -> str:
    return f"[{strip('s')} FOR s IN string_split({c}, ',')]"


def leaf(c: str) -> str:
    return f"replace(lower(list_extract([x FOR x IN {segments(c)} IF x <> ''], -1)), ' ', '_')"


def depth(c: str) -> str:
    return f"array_to_string(list_transform({segments(c)}, lambda x, i: '[D' || i || '] ' || x || ' [/D' || i || ']'), ' ')"


def lang(query: str = "origin_query") -> str:
    return f"'[LANG=' || language || '] ' || {query}"


def any_term(c: str, terms) -> str:
    """Bounds as classes, since this engine's own know ASCII only."""
    body = "|".join(t.removeprefix(r"\b").removesuffix(r"\b") for t in terms)
    return f"regexp_matches({c}, {lit(rf'(^|[^\p{{L}}\p{{N}}_])(?:{body})($|[^\p{{L}}\p{{N}}_])')})"


def yesno(c: str) -> str:
    return f"CASE WHEN {c} = '1' THEN 'yes' ELSE 'no' END"


def with_views(*names: str, more: str = "", sql: str) -> str:
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + ([more] if more else [])
    return "WITH " + ",\n".join(parts) + "\n" + sql


# Attributes


def found(pattern: str, c: str = "item_title", flags: str = "(?i)") -> str:
    return f"nullif(regexp_extract({c}, {lit(flags + pattern)}, 0), '')"


BRAND = "coalesce(" + ", ".join(
    [f"CASE WHEN regexp_matches(lower(item_title), {lit(rf'\b{b}\b')}) THEN {lit(b.replace(' ', '_'))} END" for b in A.brand_order()]
    + [f"replace(lower(trim(nullif(regexp_extract(item_title, {lit('(?i)' + p)}, 1), ''))), ' ', '_')" for p in A.BRAND_HINTS]
) + ")"
COLOR = f"CASE WHEN NOT regexp_matches(lower(item_title), {lit(A.EXCLUDED_COLOR_PHRASES[0])}) THEN lower({found(A.COLORS)}) END"
SIZE = f"lower({found(A.SIZES)})"
MATERIAL = f"lower({found(A.MATERIALS)})"
CATEGORY = f"coalesce(replace(lower({found(A.CATEGORIES)}), ' ', '_'), CASE WHEN contains(lower(item_title), 'table') THEN 'table' END)"
STYLES = "[s FOR s IN [" + ", ".join(f"regexp_replace({found(p, 'lower(item_title)')}, '\\s+', '_', 'g')" for p in A.STYLES) + "] IF s IS NOT NULL]"

QC_MAP = f"""qc_rows AS (SELECT {norm_query("origin_query")} AS query, category_path, line_no FROM pairs_qc WHERE task = 'QC' AND category_path <> ''),
qc_map AS (SELECT query, arg_max(category_path, line_no) AS category_path FROM qc_rows WHERE query <> '' GROUP BY query)"""
TAGGED = f"""{QC_MAP},
leafed AS (SELECT t.* REPLACE ({strip("item_title")} AS item_title), {leaf("m.category_path")} AS qc_leaf FROM titles t LEFT JOIN qc_map m ON {norm_query("t.origin_query")} = m.query),
attributed AS (SELECT *, coalesce({BRAND}, 'unknown') AS brand, coalesce({COLOR}, 'unknown') AS color, coalesce({SIZE}, 'unknown') AS size,
  coalesce({MATERIAL}, 'unknown') AS material, coalesce(nullif(qc_leaf, ''), {CATEGORY}, 'unknown') AS category, array_to_string({STYLES}, '|') AS styles FROM leafed),
tagged AS (SELECT *, coalesce(nullif(concat_ws(', ', {", ".join(f"CASE WHEN {k} <> 'unknown' THEN '{k}: ' || {k} END" for k in A.FIELDS)},
  CASE WHEN styles <> '' THEN 'style: ' || styles END, 'qc_leaf: ' || nullif(qc_leaf, '')), ''), 'N/A') AS attributes_str FROM attributed)"""


# Similarity and suspects


def similar(view: str, item: str, out: str = "sim") -> str:
    """CTEs for the valid rows of a view with jac and tfidf_cos, and their vocabulary."""
    grams = lambda w: f"list_concat({w}, [{w}[i] || ' ' || {w}[i + 1] FOR i IN range(1, len({w}))])"
    return f"""valid AS (SELECT * FROM {view} WHERE origin_query IS NOT NULL AND {item} IS NOT NULL AND label IN ('0', '1')),
normed AS (SELECT *, {norm("origin_query")} AS q_norm, {norm(item)} AS i_norm FROM valid),
texts AS (SELECT id, 0 AS side, regexp_extract_all(lower(q_norm), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM normed
  UNION ALL SELECT id, 1, regexp_extract_all(lower(i_norm), '[\\p{{L}}\\p{{N}}_]{{2,}}') FROM normed),
grams AS (SELECT id, side, unnest({grams("w")}) AS term FROM texts),
tf AS (SELECT id, side, term, count(*) AS tf FROM grams GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df, ln((1 + any_value(n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf, (SELECT 2 * count(*) AS n FROM normed) GROUP BY term HAVING count(*) >= 3 AND count(*) <= 0.9 * any_value(n)),
weighed AS (SELECT id, side, term, tf * idf AS w FROM tf JOIN vocab USING (term)),
sides AS (SELECT id, term, sum(CASE WHEN side = 0 THEN w ELSE 0 END) AS w_q, sum(CASE WHEN side = 1 THEN w ELSE 0 END) AS w_i FROM weighed GROUP BY ALL),
lengths AS (SELECT id, count(*) AS n_terms, sum(w_q * w_i) AS dot, sqrt(sum(w_q * w_q)) AS q_length, sqrt(sum(w_i * w_i)) AS i_length FROM sides GROUP BY id),
{out} AS (SELECT n.*, coalesce(CASE WHEN q_length > 0 AND i_length > 0 THEN dot / (q_length * i_length) END, 0) AS tfidf_cos, {jac(tokens("q_norm"), tokens("i_norm"))} AS jac
  FROM normed n LEFT JOIN lengths USING (id))"""


PROB = "coalesce(prob1, CASE WHEN logit0 IS NOT NULL AND logit1 IS NOT NULL THEN exp(logit1 - greatest(logit0, logit1)) / (exp(logit0 - greatest(logit0, logit1)) + exp(logit1 - greatest(logit0, logit1)) + 1e-12) END)"
D = U.DEFAULTS


def quantiles(rows: str) -> str:
    q = lambda c, label, p: f"quantile_cont({c}, {p}) FILTER (WHERE label = '{label}')"
    return f"""quantiles AS (SELECT language, count(*) FILTER (WHERE label = '0') AS n0, count(*) FILTER (WHERE label = '1') AS n1,
  {q("tfidf_cos", 0, 0.9)} AS q_hi_cos, {q("jac", 0, 0.9)} AS q_hi_jac, {q("tfidf_cos", 1, 0.1)} AS q_lo_cos, {q("jac", 1, 0.1)} AS q_lo_jac
  FROM {rows} WHERE language IS NOT NULL GROUP BY language),
thresholds AS (SELECT language,
  greatest(CASE WHEN n0 >= 100 THEN q_hi_cos ELSE 0.35 END, 0.35e0 * 0.6e0) AS hi_cos, greatest(CASE WHEN n0 >= 100 THEN q_hi_jac ELSE 0.2 END, 0.2e0 * 0.6e0) AS hi_jac,
  least(CASE WHEN n1 >= 100 THEN q_lo_cos ELSE 0.12 END, 0.35) AS lo_cos, least(CASE WHEN n1 >= 100 THEN q_lo_jac ELSE 0.05 END, 0.2) AS lo_jac FROM quantiles)"""


def flags(rows: str) -> str:
    """CTEs over rows with similarities, disagree and prob1: base, plain and voted suspects."""
    text = "q_norm || ' || ' || i_norm"
    return f"""{quantiles(rows)},
limits AS (SELECT r.*, coalesce(hi_cos, 0.35) AS hi_cos, coalesce(hi_jac, 0.2) AS hi_jac, coalesce(lo_cos, 0.12) AS lo_cos, coalesce(lo_jac, 0.05) AS lo_jac
  FROM {rows} r LEFT JOIN thresholds USING (language)),
ruled AS (SELECT *, CASE WHEN label = '0' THEN tfidf_cos >= hi_cos OR jac >= hi_jac ELSE tfidf_cos < lo_cos AND jac < lo_jac END AS base,
  CASE WHEN label = '0' THEN {any_term(text, U.FP_TERMS)} AND (tfidf_cos >= greatest(hi_cos * 0.9, hi_cos - 0.02) OR jac >= greatest(hi_jac * 0.9, hi_jac - 0.02))
    ELSE {any_term(text, U.FN_TERMS)} AND tfidf_cos < lo_cos * 1.1 AND jac < lo_jac * 1.1 END AS bias,
  disagree OR coalesce(CASE WHEN label = '0' THEN prob1 >= 0.9 ELSE prob1 <= 0.1 END, false) AS vote FROM limits),
flagged AS (SELECT *, base OR bias AS suspect_no_pred, base OR bias OR vote AS suspect_with_pred FROM ruled)"""


PREDICTED = f"""predicted AS (SELECT s.*, p.pred, p.prob1, CAST(s.label AS INT) IS DISTINCT FROM p.pred AS disagree
  FROM sim s LEFT JOIN (SELECT id, prediction AS pred, {PROB} AS prob1 FROM preds) p USING (id))"""
UNPREDICTED = "predicted AS (SELECT *, CAST(NULL AS INT) AS pred, CAST(NULL AS DOUBLE) AS prob1, false AS disagree FROM sim)"
QI_FLAGGED = f"{similar('pairs_qi', 'item_title')},\n{PREDICTED},\n{flags('predicted')}"
TITLES_FLAGGED = f"{similar('titles', 'item_title')},\n{UNPREDICTED},\n{flags('predicted')}"

PROMPT = "CASE WHEN prompt_for_train <> '' THEN prompt_for_train WHEN prompt_for_desc <> '' THEN prompt_for_desc END"


def generated(name: str) -> str:
    t = P.TEMPLATES[name]
    text = f"{lit(t['before'] + '### Instruction:' + chr(10) + P.QI_ICL_INSTRUCTION + chr(10) * 2 + '### Input:' + chr(10))} || input || {lit(chr(10) * 2)}"
    options = f"CASE WHEN length(input) % 2 = 0 THEN {lit('### Options:' + chr(10) + P.QI_ICL_EXAMPLE + chr(10) * 2)} ELSE '' END"
    return with_views("titles", more="r AS (SELECT 'Query: ' || origin_query || chr(10) || 'Product: ' || item_title AS input, " + yesno("label") + " AS output FROM titles)",
                      sql=f"SELECT {text} || {options} || {lit(t['after'])} || output AS prompt, count(*) AS n FROM r GROUP BY 1")


RESPONSE = strip("split_part(full_text, '### Response:', 2)")


def part(body: str) -> str:
    return f"CASE WHEN regexp_matches(gen_text, {lit(body)}, 'is') THEN {strip(f'regexp_extract(gen_text, {lit(body)}, 1, {lit("is")})')} END"


GENERATION = f"""parsed AS (SELECT id, {part(r"\[TAGS\](.+?)\[/TAGS\]")} AS tags_block, {part(r"\[DESC\](.+?)\[/DESC\]")} AS "desc",
  {part(r"\[LABEL\]\s*([01])\s*\[/LABEL\]")} AS pred_label, {strip("gen_text")} AS raw FROM gens)"""


def line(text: str, key: str) -> str:
    first = f"list_extract([l FOR l IN string_split({text}, chr(10)) IF starts_with(lower(l), '{key}:')], 1)"
    return f"coalesce({strip(f'substr({first}, {len(key) + 2})')}, '')"


def over(view: str, sql: str, more: str = "") -> str:
    return with_views(view, more=more, sql=sql)


FILLED = "CASE WHEN split_test <= quota THEN 'test' ELSE 'train' END"
SPLIT = f"""rows AS (SELECT id, {yesno("label")} AS output FROM pairs_qi),
sizes AS (SELECT output, count(*) AS n FROM rows GROUP BY 1),
wanted AS (SELECT *, ceil(sum(n) OVER () * 0.2e0) AS w, n * ceil(sum(n) OVER () * 0.2e0) / sum(n) OVER () AS share FROM sizes),
quotas AS (SELECT output, floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, output) <= w - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS quota FROM wanted),
ranked AS (SELECT *, row_number() OVER (PARTITION BY output ORDER BY (CAST(id AS BIGINT) + 42) * 2654435761 % 4294967296, id) AS split_test FROM rows JOIN quotas USING (output))"""

LENGTHS = f"""ids AS (SELECT id, [length(t) FOR t IN {tokens(norm("origin_query"))}] AS p, [length(t) FOR t IN {tokens(norm("item_title"))}] AS i FROM titles),
cut AS (SELECT id, p, list_concat(p, i)[:1024] AS c FROM ids),
input AS (SELECT id, p, CASE WHEN len(c) < 1024 THEN list_append(c, 0) ELSE c END AS x FROM cut)"""

BIAS = lambda terms: with_views("titles", "pairs_qi", sql=" UNION ALL ".join(
    f"SELECT '{v}' AS view, id, {any_term(norm('origin_query') + " || ' || ' || " + norm('item_title'), terms)} AS hit FROM {v}" for v in ("titles", "pairs_qi")
))

ORACLE_SQL: dict[str, str] = {
    "project_common_fields": over("pairs_qi", "SELECT id, language, origin_query, item_title, label FROM pairs_qi"),
    "falsy_coalesce": over("gens", "SELECT id, CASE WHEN prompt_for_train <> '' THEN prompt_for_train WHEN prompt_for_desc <> '' THEN prompt_for_desc ELSE coalesce(id, '') END AS value FROM gens"),
    "dropna_subset": over("pairs_qi", "SELECT id, language, origin_query, item_title, label FROM pairs_qi WHERE origin_query IS NOT NULL AND item_title IS NOT NULL AND label IS NOT NULL"),
    "label_isin": over("pairs_qi", "SELECT id, label FROM pairs_qi WHERE origin_query IS NOT NULL AND item_title IS NOT NULL AND label IN ('0', '1')"),
    "label_to_yesno": over("pairs_qi", f"SELECT id, {yesno('label')} AS output FROM pairs_qi"),
    "response_to_pred": over("gens", f"SELECT id, CAST(lower({RESPONSE}) = 'yes' AS INT) AS prediction FROM gens"),
    "positional_id": over("pairs_qc", "SELECT id, row_number() OVER (ORDER BY line_no) AS position FROM pairs_qc"),
    "filter_has_prompt": over("gens", f"SELECT id, {PROMPT} AS prompt FROM gens WHERE {PROMPT} IS NOT NULL"),
    "limit_with_prompt": over("gens", f"SELECT id, {PROMPT} AS prompt FROM gens WHERE {PROMPT} IS NOT NULL ORDER BY line_no LIMIT 100"),
    "tagged_or_raw": over("titles", f"SELECT id, CASE WHEN length(id) % 2 = 0 THEN {strip('item_title')} || ' [ATTR] x: y' ELSE item_title END AS title FROM titles"),
    "bias_terms_fp": BIAS(U.FP_TERMS),
    "bias_terms_fn": BIAS(U.FN_TERMS),
    "normalize_text": over("pairs_qi", f"SELECT id, {norm('origin_query')} AS q_norm, {norm('item_title')} AS i_norm FROM pairs_qi"),
    "normalize_query": over("pairs_qc", f"SELECT id, {norm_query('origin_query')} AS query FROM pairs_qc"),
    "tokenize": over("pairs_qi", f"SELECT id, len({tokens(norm('item_title'))}) AS n_tokens, array_to_string({tokens(norm('item_title'))}, '|') AS tokens FROM pairs_qi"),
    "jaccard": over("pairs_qi", f"SELECT id, round({jac(tokens('q'), tokens('i'))}, 6) AS jac FROM n", f"n AS (SELECT id, {norm('origin_query')} AS q, {norm('item_title')} AS i FROM pairs_qi)"),
    "leaf_category": over("pairs_qc", f"SELECT id, {leaf('category_path')} AS leaf FROM pairs_qc"),
    "category_depth_tags": over("pairs_qc", f"SELECT id, {depth('category_path')} AS category_path FROM pairs_qc"),
    "lang_tag": over("pairs_qc", f"SELECT id, {lang()} AS origin_query FROM pairs_qc"),
    "qc_tagging": over("pairs_qc", f"SELECT id, task, language, {lang()} AS origin_query, {depth('category_path')} AS category_path, label FROM pairs_qc"),
    "extract_brand": over("titles", f"SELECT id, {BRAND} AS brand FROM titles"),
    "extract_color": over("titles", f"SELECT id, {COLOR} AS color FROM titles"),
    "extract_size": over("titles", f"SELECT id, {SIZE} AS size FROM titles"),
    "extract_material": over("titles", f"SELECT id, {MATERIAL} AS material FROM titles"),
    "extract_category": over("titles", f"SELECT id, {CATEGORY} AS category FROM titles"),
    "extract_styles": over("titles", f"SELECT id, array_to_string({STYLES}, '|') AS styles FROM titles"),
    "attributes_struct": with_views("titles", "pairs_qc", more=TAGGED, sql="SELECT id, brand, category, material, color, size, styles FROM tagged"),
    "attributes_str": with_views("titles", "pairs_qc", more=TAGGED, sql="SELECT id, attributes_str FROM tagged"),
    "attr_tag": with_views("titles", "pairs_qc", more=TAGGED, sql=f"SELECT id, item_title || CASE WHEN attributes_str <> 'N/A' THEN ' [ATTR] ' || attributes_str ELSE '' END AS item_title_tagged, {strip(lang())} AS origin_query_tagged FROM tagged"),
    "caption_prompt": with_views("titles", "pairs_qc", more=TAGGED, sql=f"""SELECT id, {lit(P.GUIDE + chr(10) * 2 + P.INSTRUCTION + chr(10) + P.FORMAT_RULES + chr(10) * 2 + "[INPUT]" + chr(10) + "[LANG=")} || language || ']' || chr(10) || 'query: ' || origin_query || chr(10) || 'title: ' || item_title || chr(10) || 'attributes: ' || attributes_str || {lit(chr(10) * 2 + "[CONSTRAINTS]" + chr(10) + P.CONSTRAINTS)} AS prompt_for_train FROM tagged"""),
    "qc_map_build": with_views("pairs_qc", more=QC_MAP, sql="SELECT query, category_path FROM qc_map"),
    "qc_leaf_lookup": with_views("titles", "pairs_qc", more=QC_MAP, sql=f"SELECT id, {leaf('m.category_path')} AS qc_leaf FROM titles t LEFT JOIN qc_map m ON {norm_query('t.origin_query')} = m.query"),
    "prompt_alpaca": generated("alpaca"),
    "prompt_mistral": generated("mistral"),
    "get_response": over("gens", f"SELECT id, {RESPONSE} AS response FROM gens"),
    "parse_generation": over("gens", "SELECT *, tags_block IS NOT NULL AND \"desc\" IS NOT NULL AND pred_label IS NOT NULL AS is_valid FROM parsed", GENERATION),
    "extract_query_line": over("titles", f"SELECT id, {line("('Title' || chr(10) || 'QUERY:  ' || origin_query || ' ' || chr(10) || 'query: second' || chr(10) || 'Product: ' || item_title)", 'query')} AS value FROM titles"),
    "extract_product_line": over("titles", f"SELECT id, {line("(CASE WHEN language = 'ko' THEN origin_query ELSE 'Query: ' || origin_query || chr(10) || 'product: ' || item_title END)", 'product')} AS value FROM titles"),
    "convert_qc_icl": over("pairs_qc", f"SELECT {lit(P.QC_ICL_INSTRUCTION)} AS instruction, 'Query: ' || origin_query || chr(10) || 'Category Path: ' || category_path AS input, {yesno('label')} AS output, {lit(P.QC_ICL_EXAMPLE)} AS options, language, count(*) AS n FROM pairs_qc GROUP BY ALL"),
    "convert_qi_icl": over("titles", f"SELECT {lit(P.QI_ICL_INSTRUCTION)} AS instruction, 'Query: ' || origin_query || chr(10) || 'Product: ' || item_title AS input, {yesno('label')} AS output, {lit(P.QI_ICL_EXAMPLE)} AS options, language, count(*) AS n FROM titles GROUP BY ALL"),
    "convert_qc_final": over("pairs_qc", f"SELECT 'Query: ' || {lang()} || chr(10) || 'Category: ' || CASE WHEN category_path <> '' THEN {depth('category_path')} ELSE category_path END AS input, {yesno('label')} AS output, language, CAST(NULL AS VARCHAR) AS gen_label, count(*) AS n FROM pairs_qc GROUP BY ALL"),
    "convert_qi_final": with_views("titles", "gens", more=GENERATION, sql=f"""SELECT 'Query: ' || origin_query || chr(10) || 'Product: ' || item_title || CASE WHEN coalesce(tags_block, '') <> '' OR coalesce("desc", '') <> '' THEN chr(10) || chr(10) || '[GEN_TAGS] ' || coalesce(tags_block, '') || chr(10) || '[GEN_DESC] ' || coalesce("desc", '') ELSE '' END AS input, {yesno('label')} AS output, language, pred_label AS gen_label, count(*) AS n FROM titles JOIN parsed USING (id) GROUP BY ALL"""),
    "tfidf_corpus": over("pairs_qi", "SELECT id, 'q' AS side, q_norm AS text FROM normed UNION ALL SELECT id, 'i', i_norm FROM normed", similar("pairs_qi", "item_title")),
    "tfidf_vocab": over("pairs_qi", "SELECT term, df, round(idf, 6) AS idf FROM vocab", similar("pairs_qi", "item_title")),
    "tfidf_weights": over("pairs_qi", "SELECT id, n_terms, round(q_length, 6) AS q_length, round(i_length, 6) AS i_length FROM lengths", similar("pairs_qi", "item_title")),
    "tfidf_cosine": over("pairs_qi", "SELECT id, round(tfidf_cos, 6) AS tfidf_cos FROM sim", similar("pairs_qi", "item_title")),
    "lang_quantiles": over("titles", "SELECT language, n0, n1, round(q_hi_cos, 6) AS q_hi_cos, round(q_hi_jac, 6) AS q_hi_jac, round(q_lo_cos, 6) AS q_lo_cos, round(q_lo_jac, 6) AS q_lo_jac FROM quantiles", f"{similar('titles', 'item_title')},\n{quantiles('sim')}"),
    "lang_thresholds": over("titles", "SELECT language, round(hi_cos, 6) AS hi_cos, round(hi_jac, 6) AS hi_jac, round(lo_cos, 6) AS lo_cos, round(lo_jac, 6) AS lo_jac FROM thresholds", f"{similar('titles', 'item_title')},\n{quantiles('sim')}"),
    "lang_thresholds_fixed": over("titles", f"SELECT DISTINCT language, {', '.join(f'{v}::DOUBLE AS {k}' for k, v in D.items())} FROM titles"),
    "threshold_lookup": over("titles", f"SELECT id, {', '.join(f'round(coalesce({k}, {v}), 6) AS {k}' for k, v in D.items())} FROM titles LEFT JOIN (SELECT * FROM thresholds WHERE language <> 'ko') USING (language)", f"{similar('titles', 'item_title')},\n{quantiles('sim')}"),
    "pred_left_join": with_views("pairs_qi", "preds", sql=f"SELECT a.id, label, prediction AS pred, round({PROB}, 6) AS prob1 FROM pairs_qi a LEFT JOIN preds p ON a.id = p.id"),
    "pred_disagree": with_views("pairs_qi", "preds", sql="SELECT a.id, CAST(label AS INT) IS DISTINCT FROM prediction AS disagree FROM pairs_qi a LEFT JOIN preds p ON a.id = p.id"),
    "prob1_from_logits": over("preds", f"SELECT id, round({PROB}, 6) AS prob1 FROM preds"),
    "prob_from_logprobs": over("preds", "SELECT id, round(exp(logit1 - greatest(logit1, logit0)) / (exp(logit1 - greatest(logit1, logit0)) + exp(logit0 - greatest(logit1, logit0))), 6) AS prob1 FROM preds"),
    "suspect_base": over("titles", "SELECT id, base AS suspect FROM ruled", TITLES_FLAGGED),
    "suspect_no_pred": over("titles", "SELECT id, suspect_no_pred FROM flagged", TITLES_FLAGGED),
    "suspect_with_pred": with_views("pairs_qi", "preds", more=QI_FLAGGED, sql="SELECT id, suspect_no_pred, suspect_with_pred FROM flagged"),
    "suspect_report": with_views("pairs_qi", "preds", more=QI_FLAGGED, sql="SELECT label, count(id) AS n, sum(suspect_with_pred::INT)::BIGINT AS sus_with_pred, sum(suspect_no_pred::INT)::BIGINT AS sus_no_pred, (sum(suspect_with_pred::INT) - sum(suspect_no_pred::INT))::BIGINT AS diff FROM flagged GROUP BY label"),
    "refine_pipeline_qi": with_views("pairs_qi", "preds", more=QI_FLAGGED, sql="SELECT id, language, origin_query, item_title, label FROM flagged WHERE NOT suspect_with_pred"),
    "refined_output_qi": over("titles", "SELECT id, language, origin_query, item_title, label FROM flagged WHERE NOT suspect_with_pred", TITLES_FLAGGED),
    "refined_output_qc": over("pairs_qc", "SELECT id, language, origin_query, category_path, label FROM flagged WHERE NOT suspect_with_pred", f"{similar('pairs_qc', 'category_path')},\n{UNPREDICTED},\n{flags('predicted')}"),
    "output_value_counts": over("pairs_qi", f"SELECT {yesno('label')} AS output, count(*) AS n FROM pairs_qi GROUP BY 1"),
    "f1_score": with_views("pairs_qi", "preds", sql="SELECT round(coalesce(2.0 * sum((label = '1' AND prediction = 1)::INT) / nullif(2 * sum((label = '1' AND prediction = 1)::INT) + sum((label = '0' AND prediction = 1)::INT) + sum((label = '1' AND prediction = 0)::INT), 0), 0)::DOUBLE, 6) AS f1 FROM pairs_qi JOIN preds USING (id)"),
    "stage_counts": with_views("pairs_qi", "preds", more=QI_FLAGGED, sql="SELECT count(*) AS n_valid, count(*) FILTER (WHERE suspect_with_pred) AS n_suspect, count(*) FILTER (WHERE NOT suspect_with_pred) AS n_clean FROM flagged"),
    "resume_anti_join": with_views("pairs_qi", "preds", sql="SELECT id FROM pairs_qi WHERE id NOT IN (SELECT id FROM preds)"),
    "seeded_shuffle": over("titles", "SELECT id, (CAST(id AS BIGINT) + 42) * 2654435761 % 4294967296 AS shuffle_key FROM titles"),
    "stratified_split": over("pairs_qi", f"SELECT id, output, {FILLED} AS split FROM ranked".replace("{FILLED}", FILLED), SPLIT),
    "mask_prompt_labels": over("titles", "SELECT id, array_to_string(list_concat([-100 FOR t IN x[:least(len(p), len(x))]], x[least(len(p), len(x)) + 1:]), ' ') AS labels, (len(x) - least(len(p), len(x)))::BIGINT AS n_loss FROM input", LENGTHS),
    "token_total": over("titles", "SELECT sum(len(x))::BIGINT AS n_tokens FROM input", LENGTHS),
    "scan_jsonl": over("gens", "SELECT * FROM gens"),
    "scan_json_array": over("gens", "SELECT id, gen_text, prompt_for_train FROM gens"),
}
ORACLE_SQL["lang_quantiles_by_rank"] = ORACLE_SQL["lang_quantiles"]
