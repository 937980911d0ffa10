"""Prompts, chat templates, parsing of generations and the instruction formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import falsy, ustrip

# Guide, rules and examples, word for word.
GUIDE = "You are a precise data labeler and copywriter for an e-commerce catalog."
INSTRUCTION = (
    "Given the user query and the product title/attributes, output:\n"
    "1) inline tags with a fixed, non-nested tag set;\n"
    "2) a concise English description;\n"
    "3) a binary relevance label (1 if the item fully matches the query on product type, brand, model, and key attributes; otherwise 0)."
)
FORMAT_RULES = (
    "Use only these tags (lowercase, no nesting, words joined by underscores if needed):\n"
    "[cat], [mat], [color], [size], [style], [feature], [audience], [brand]\n"
    "Output format (strictly):\n"
    "[TAGS] ... [/TAGS]\n"
    "[DESC] ... [/DESC]\n"
    "[LABEL] 0 or 1 [/LABEL]"
)
CONSTRAINTS = (
    "- Use only verifiable info from the title/attributes/category context.\n"
    "- Do not mention unknown attributes.\n"
    "- Be objective and concise. Description should be 1–2 sentences.\n"
    "- Respond in English.\n"
    "- Label 1 only if the item corresponds to the query in product type, brand, model, and salient attributes; else 0."
)
QC_ICL_INSTRUCTION = 'You are given a user query and a product category path.\nDetermine whether the category is appropriate for the query.\nRespond only with "yes" or "no".'
QC_ICL_EXAMPLE = """You are given a user query and a product category path.
Determine whether the category is appropriate for the query.
Respond only with "yes" or "no".

Query: 1/14 rc volvo fh16
Category Path: toys & hobbies,remote control toys,rc trucks

Answer: yes

Query: 미니핫도그
Category Path: home & garden,home textile,carpet

Answer: no

"""
QI_ICL_INSTRUCTION = 'You are given a user query and a product title.\nDecide if the product is relevant to the query.\nRespond only with "yes" or "no".'
QI_ICL_EXAMPLE = """You are given a user query and a product title.
Decide if the product is relevant to the query.
Respond only with "yes" or "no".

Query: wireless bluetooth earbuds
Product: Sony WF-1000XM5 Noise Cancelling Headphones

Answer: yes

Query: leather handbag
Product: Wireless Bluetooth Earbuds

Answer: no

"""
QC_INSTRUCTION = 'You are given a user query and a product category.\nDecide if the category is relevant to the query.\nRelevant: matches user intent (correct category).\nNot relevant: unrelated or wrong category.\nRespond only with "yes" or "no".'
QC_EXAMPLE = """Decide if the category is relevant to the query.
Relevant: matches user intent (correct category).
Not relevant: unrelated or wrong category.
Respond only with "yes" or "no".

Query: [LANG=es] por watch
Category: [D1] watches [/D1] [D2] pocket & fob watches [/D2]
Answer: yes

Query: [LANG=ko] 베이스젤
Category: [D1] beauty & health [/D1] [D2] nail art & tools [/D2] [D3] nail art [/D3] [D4] top coat [/D4]
Answer: no
"""
QI_INSTRUCTION = 'You are given a user query and a product title.\nDecide if the product is relevant to the query.\nRelevant: matches user intent (category/type match, brand/specs may differ).\nNot relevant: unrelated type or accessory instead of main item.\nRespond only with "yes" or "no".'
QI_EXAMPLE = """You are given a user query and a product title.
Decide if the product is relevant to the query.
Relevant: matches user intent (category/type match, brand/specs may differ).
Not relevant: unrelated type or accessory instead of main item.
Respond only with "yes" or "no".

Query: [LANG=en] wireless bluetooth earbuds
Product: Sony WF-1000XM5 Noise Cancelling Headphones
Answer: yes

Query: [LANG=ko] 유리컵
Product: Wireless Bluetooth Earbuds
Answer: no
"""
_PREAMBLE = "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.\n\n"
TEMPLATES = {
    "alpaca": {"before": _PREAMBLE, "after": "### Response:\n", "split": "### Response:"},
    "mistral": {"before": "[INST] " + _PREAMBLE, "after": " [/INST] ### Response:\n", "split": "[/INST] ### Response:"},
}


def template(name: str = "alpaca") -> dict[str, str]:
    """A chat template by name, ``alpaca`` if it is empty."""
    name = name or "alpaca"
    if name not in TEMPLATES:
        raise ValueError(f"no template named {name}; there are {', '.join(TEMPLATES)}")
    return TEMPLATES[name]


def generate_prompt(instruction: Column, text: Column, options: Column | None = None, label: Column | None = None, name: str = "alpaca") -> Column:
    """The full prompt; options and label only where they are neither null nor empty.

    A null input reads ``None``, as a null instruction does.
    """
    t = template(name)
    none = lambda c: F.coalesce(c, F.lit("None"))
    parts = [F.lit(t["before"] + "### Instruction:\n"), none(instruction), F.lit("\n\n### Input:\n"), none(text), F.lit("\n\n")]
    if options is not None:
        parts.append(F.coalesce(F.concat(F.lit("### Options:\n"), falsy(options), F.lit("\n\n")), F.lit("")))
    parts.append(F.lit(t["after"]))
    if label is not None:
        parts.append(F.coalesce(label, F.lit("")))
    return F.concat(*parts)


def get_response(text: Column, name: str = "alpaca", strict: bool = False) -> Column:
    """What stands between the first and the second response mark, stripped.

    Without a mark: empty, or an error at run time if ``strict``.
    """
    mark = F.lit(template(name)["split"])
    found = ustrip(F.split_part(text, mark, F.lit(2)))
    return F.when(F.contains(text, mark), found).otherwise(F.raise_error(F.lit("no response mark"))) if strict else found


def caption_prompt(query: Column, title: Column, attributes: Column, language: Column) -> Column:
    """The English captioning prompt of a query and a product."""
    return ustrip(
        F.concat(
            F.lit(f"{GUIDE}\n\n{INSTRUCTION}\n{FORMAT_RULES}\n\n[INPUT]\n[LANG="), language, F.lit("]\nquery: "), query,
            F.lit("\ntitle: "), title, F.lit("\nattributes: "), attributes, F.lit(f"\n\n[CONSTRAINTS]\n{CONSTRAINTS}\n"),
        )
    )


def parse_generation(text: Column) -> Column:
    """``tags_block, desc, pred_label, raw, is_valid`` of a generated text; absent parts are null."""

    def between(body: str) -> Column:
        pattern = "(?isU)" + body
        return F.when(text.rlike(pattern), ustrip(F.regexp_extract(text, pattern, 1)))

    tags, desc = between(r"\[TAGS\](.+?)\[/TAGS\]"), between(r"\[DESC\](.+?)\[/DESC\]")
    label = between(r"\[LABEL\]\s*([01])\s*\[/LABEL\]")
    return F.struct(
        tags.alias("tags_block"), desc.alias("desc"), label.alias("pred_label"), ustrip(text).alias("raw"),
        (tags.isNotNull() & desc.isNotNull() & label.isNotNull()).alias("is_valid"),
    )


def label_to_yesno(label: Column, has_label: bool = True) -> Column:
    """``yes`` for 1, ``no`` for anything else, null too; empty where labels are not given."""
    return F.when(label.cast("string") == "1", F.lit("yes")).otherwise(F.lit("no")) if has_label else F.lit("")


def response_to_pred(response: Column) -> Column:
    return (F.lower(ustrip(response)) == "yes").cast("int")


def icl_format(df: DataFrame, task: str, has_label: bool = True) -> DataFrame:
    """Instruction rows for tuning the scorer: ``instruction, input, output, options, language``."""
    item, name, instruction, example = {
        "QC": ("category_path", "Category Path", QC_ICL_INSTRUCTION, QC_ICL_EXAMPLE),
        "QI": ("item_title", "Product", QI_ICL_INSTRUCTION, QI_ICL_EXAMPLE),
    }[task.upper()]
    text = F.concat(F.lit("Query: "), F.col("origin_query"), F.lit(f"\n{name}: "), F.col(item))
    return df.select(
        F.lit(instruction).alias("instruction"), text.alias("input"), label_to_yesno(F.col("label"), has_label).alias("output"),
        F.lit(example).alias("options"), _optional(df, "language", "unknown").alias("language"),
    )


def _optional(df: DataFrame, name: str, default: str | None = None) -> Column:
    return F.col(name) if name in df.columns else F.lit(default).cast("string")


def tagged_or_raw(df: DataFrame, name: str) -> Column:
    """``<name>_tagged`` where there is one, else ``name``."""
    return F.coalesce(F.col(f"{name}_tagged"), F.col(name)) if f"{name}_tagged" in df.columns else F.col(name)


def final_format(df: DataFrame, task: str, split: str = "train", label: str | None = None) -> DataFrame:
    """Instruction rows for the final tuning, with generated tags and description where there are any."""
    item, name, instruction, example, own = {
        "QC": ("category_path", "Category", QC_INSTRUCTION, QC_EXAMPLE, "label"),
        "QI": ("item_title", "Product", QI_INSTRUCTION, QI_EXAMPLE, "gold_label"),
    }[task.upper()]
    given = dict(df.dtypes).get("generation", "").startswith("struct")
    part = lambda k: F.col(f"generation.{k}") if given and f"{k}:" in dict(df.dtypes)["generation"] else F.lit(None).cast("string")
    tags, desc = F.coalesce(part("tags_block"), F.lit("")), F.coalesce(part("desc"), F.lit(""))
    extra = F.when((tags != "") | (desc != ""), F.concat(F.lit("\n\n[GEN_TAGS] "), tags, F.lit("\n[GEN_DESC] "), desc)).otherwise(F.lit(""))
    text = F.concat(F.lit("Query: "), tagged_or_raw(df, "origin_query"), F.lit(f"\n{name}: "), tagged_or_raw(df, item), extra)
    return df.select(
        F.lit(instruction).alias("instruction"), text.alias("input"),
        label_to_yesno(_optional(df, label or own), split == "train").alias("output"), F.lit(example).alias("options"),
        _optional(df, "language", "unknown").alias("language"), part("pred_label").alias("gen_label"),
    )
