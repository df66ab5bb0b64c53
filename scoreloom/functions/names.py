"""Column expressions for file names, model tokens, document types and text flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Known document types, model tokens with labels, aliases, and display names.
DOC_TYPES = ("ADR", "PRD", "TestPlan")
MODEL_REGISTRY = {
    "gemini": "Gemini", "claude": "Claude", "chatgpt": "ChatGPT", "qwen3_6": "Qwen3.6", "mistral": "Mistral",
    "llama": "LLaMA", "qwen": "Qwen", "gemma": "Gemma", "ministral": "Ministral",
}
MODEL_ALIASES = {"gpt": "chatgpt"}
REFERENCE_NAMES = {
    "claude": "Claude", "gemini": "Gemini", "chatgpt": "ChatGPT", "gpt": "ChatGPT", "gpt-5.5": "ChatGPT",
    "openai": "ChatGPT", "mistral": "Mistral", "qwen3_6": "Qwen3_6", "qwen3-6": "Qwen3_6", "qwen_3_6": "Qwen3_6",
}
MODEL_NAMES = {"gemma": "Gemma", "ministral": "Ministral", "qwen": "Qwen"}
FAMILY_MAP = {("Gemini", "gemma"): "Google", ("Qwen3_6", "qwen"): "Alibaba", ("Mistral", "ministral"): "Mistral"}
WORD_COUNT_MODELS = ("gemma", "ministral", "qwen")

#: Python's idea of a word character, spelled out for Java.
WORD = r"[\p{L}\p{N}_]"


def lookup(mapping: dict[str, str], key: Column, default: Column) -> Column:
    """``mapping[key]``, or ``default`` where it has no such key."""
    if not mapping:
        return default
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, key), default)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_model_token(token: Column, aliases: dict[str, str] = MODEL_ALIASES) -> Column:
    return lookup(aliases, F.lower(token), F.lower(token))


def display_name(token: Column, registry: dict[str, str] = MODEL_REGISTRY, aliases: dict[str, str] = MODEL_ALIASES) -> Column:
    canonical = normalize_model_token(token, aliases)
    return lookup(registry, canonical, F.upper(canonical))


def normalize_name(value: Column, names: dict[str, str]) -> Column:
    """The display form of a reference or model name; others are only trimmed."""
    return lookup(names, F.lower(F.trim(value)), F.trim(value))


def parse_document_name(name: Column, tokens: list[str] | tuple[str, ...] = (*MODEL_REGISTRY, *MODEL_ALIASES), doc_types: tuple[str, ...] = DOC_TYPES, aliases: dict[str, str] = MODEL_ALIASES, longest: int = 4) -> Column:
    """``struct(document_id, model, doc_type)`` of ``{document_id}_{model}_{doc_type}.md``.

    The longest run of up to four ``_`` parts before the type that is a known
    token is the model; without one, all three are null.
    """
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")
    doc_type = lookup({t.lower(): t for t in doc_types}, F.lower(F.element_at(parts, -1)), F.lit(None).cast("string"))
    rest = F.when(doc_type.isNotNull(), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    known = F.array(*map(F.lit, tokens))
    found = F.array_max(F.filter(F.sequence(F.lit(1), F.lit(longest)), lambda n: (n <= F.size(rest)) & F.array_contains(known, F.lower(F.array_join(F.slice(rest, F.size(rest) - n + 1, F.least(n, F.size(rest))), "_")))))
    model = normalize_model_token(F.array_join(F.slice(rest, F.size(rest) - found + 1, found), "_"), aliases)
    document = F.nullif(F.array_join(F.slice(rest, F.lit(1), F.size(rest) - found), "_"), F.lit(""))
    return F.struct(F.when(found.isNotNull(), document).alias("document_id"), F.when(found.isNotNull(), model).alias("model"), F.when(found.isNotNull(), doc_type).alias("doc_type"))


def word_count_keys(name: Column, models: tuple[str, ...] = WORD_COUNT_MODELS) -> Column:
    """``struct(document_id, model)`` by the first two parts; both null unless the model is one of ``models``."""
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")
    model = F.try_element_at(parts, F.lit(2))
    keep = model.isin(list(models))
    return F.struct(F.when(keep, F.element_at(parts, 1)).alias("document_id"), F.when(keep, model).alias("model"))


def strip_front_matter(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?s)\A---\s*\n.*?\n---\s*\n", ""))


def length_flag(text: Column) -> Column:
    n = F.length(strip(text))
    return F.when(n == 0, "empty").when(n < 50, "too_short").when(n < 100, "very_short").when(n < 200, "short").otherwise("ok")


def is_valid(text: Column, at_least: int = 10) -> Column:
    """Enough stripped characters for the vocabulary, n-gram recall and vector metrics."""
    return F.coalesce(F.length(strip(text)) >= at_least, F.lit(False))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}+"))


def classify_doc_type(document_id: Column) -> Column:
    """``patent`` or ``report`` by the prefix of the id."""
    key = F.upper(F.trim(document_id))
    return F.when(key.startswith("PAT"), "patent").when(key.startswith("RPT"), "report").when(key.startswith("10"), "patent").otherwise("report")


def metric_status(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value), "failed").otherwise("ok")


def strip_code_fences(text: Column) -> Column:
    return F.regexp_replace(text, r"```[\s\S]*?```", "\n<code_block/>\n")


def sanitize_name(value: Column) -> Column:
    """Without parenthesised notes; other than word characters become single underscores."""
    plain = F.regexp_replace(F.regexp_replace(value, r"\([^)]*\)", ""), r"[^\p{L}\p{N}_]+", "_")
    return F.regexp_replace(F.regexp_replace(plain, "_+", "_"), "^_+|_+$", "")


def model_tag(name: Column, prefixes: dict[str, str]) -> Column:
    """The tag of the longest known prefix of a model name, else the name made safe for paths."""
    safe = F.translate(F.lower(name), '\\/:*?"<>| ', "__________")
    tag = safe
    for prefix in sorted(prefixes, key=len):
        tag = F.when(F.lower(name).startswith(prefix.lower()), F.lit(prefixes[prefix])).otherwise(tag)
    return tag


def unique_stem(document: Column, image: Column) -> Column:
    """Document and image stems joined, without repeating the document's."""
    return F.when(image.startswith(document), image).otherwise(F.concat_ws("_", document, image))


def numbered_stems(rows: DataFrame, folder: list[str], stem: str, order: str) -> DataFrame:
    """``unique``: the stem, and from its second row in a folder on with ``_2``, ``_3``, ... behind it, by ``order``; a stem that so comes to exist already counts on.

    Letter case does not part names, as on file systems that ignore it.
    """
    own = Window.partitionBy(*folder, F.lower(stem)).orderBy(order)
    numbered = rows.withColumn("__n", F.row_number().over(own)).withColumn("unique", F.when(F.col("__n") == 1, F.col(stem)).otherwise(F.concat_ws("_", stem, "__n")))
    # A numbered name may be another row's own stem; such rows take their number after a double mark.
    taken = rows.select(*folder, F.lower(stem).alias("__low")).distinct().withColumn("__taken", F.lit(True))
    met = numbered.withColumn("__low", F.lower("unique")).join(taken, [*folder, "__low"], "left")
    return met.withColumn("unique", F.when((F.col("__n") > 1) & F.col("__taken"), F.concat_ws("__", stem, "__n")).otherwise(F.col("unique"))).select(*rows.columns, "unique")
