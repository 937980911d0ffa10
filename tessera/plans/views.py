"""Views that stand for the engine's inputs, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "pairs_qi": """SELECT CAST(d.doc_id AS STRING) AS id, d.lang AS language, split_part(d.text, '.', 1) AS origin_query,
 d.text AS item_title, CAST(l.quality AS STRING) AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "titles": """SELECT CAST(p_partkey AS STRING) AS id,
 CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'es' WHEN 2 THEN 'ko' ELSE 'de' END AS language,
 CASE WHEN p_partkey % 13 = 0 THEN 'wireless earbuds' ELSE p_name END AS origin_query,
 concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN concat(' by ', replace(p_brand, '#', '-')) WHEN p_partkey % 3 = 1 THEN ' Hot Wheels Diecast 1/64' ELSE ' Bandai' END, ' ',
 CASE p_size % 7 WHEN 0 THEN 'Solid Wood Desk' WHEN 1 THEN 'Star Wars Gundam Figure' WHEN 2 THEN 'Stainless Steel Chair' WHEN 3 THEN 'Model Kits' WHEN 4 THEN 'Red Pyramid Thing' WHEN 5 THEN 'PU Leather Coffee Table Set' ELSE 'Mens 4K HDMI Table XL' END,
 CASE WHEN p_partkey % 2 = 0 THEN concat(' ', CAST(p_size AS STRING), ' cm') ELSE '' END) AS item_title,
 CAST(CAST(floor(p_partkey / 4e0) AS BIGINT) % 2 AS STRING) AS label FROM part""",
    "pairs_qc": """SELECT CAST(p_partkey AS STRING) AS id, 'QC' AS task,
 CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'es' WHEN 2 THEN 'ko' ELSE 'de' END AS language,
 concat('  ', upper(p_name), ' ') AS origin_query,
 CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 17 = 0 THEN ' , ' ELSE concat(lower(p_type), ', ', lower(p_brand), ',', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END) END AS category_path,
 CAST(CAST(floor(p_partkey / 4e0) AS BIGINT) % 2 AS STRING) AS label, p_partkey AS line_no FROM part""",
    "preds": """SELECT CAST(doc_id AS STRING) AS id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS prediction,
 CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id * 37 % 1000) / 1000e0 END AS prob1,
 CASE WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN (doc_id % 13) / 4e0 END AS logit0,
 CASE WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN (doc_id % 17) / 4e0 END AS logit1
 FROM labels WHERE doc_id % 11 <> 0""",
    "gens": """SELECT CAST(p_partkey AS STRING) AS id,
 concat('  [TAGS] [brand] ', lower(p_brand), ' [/TAGS]', chr(10), CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('[desc] ', p_name, chr(10), ' ', p_type, ' [/Desc]', chr(10)) END,
 '[LABEL] ', CAST(p_partkey % 3 AS STRING), ' [/LABEL]', chr(10)) AS gen_text,
 concat('prompt for ', p_name, chr(10), '### Response:', CASE p_partkey % 4 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'yes.' WHEN 2 THEN concat('no', chr(10)) ELSE concat(chr(10), 'YES', chr(10)) END) AS full_text,
 CASE WHEN p_partkey % 6 = 0 THEN '' ELSE concat('prompt ', p_name) END AS prompt_for_train, CAST(NULL AS STRING) AS prompt_for_desc, p_partkey AS line_no FROM part""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables of a folder."""
    sql, given = VIEWS[name], {}
    for t in ("documents", "labels", "part"):
        if f"FROM {t}" in sql or f"JOIN {t}" in sql:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
            given[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    out = spark.sql(sql, **given)
    if name == "preds":
        out = out.withColumn("logits", F.when(F.col("logit0").isNotNull() & F.col("logit1").isNotNull(), F.array("logit0", "logit1")))
    return out
