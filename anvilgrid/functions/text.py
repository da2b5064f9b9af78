"""Text expressions: question tokens, answers, prompts, vocabulary forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must be these for equal results.
STOPWORDS = "a an and are as at be by does for from how in is it of on or release the to what when which with".split()
RELEASE_TAG = r"(?i)\[\s*3GPP\s+Release\s+(\d+)\s*\]"
OPTION = r"(?i)\boption\s*([1-9][0-9]*)\b"
OPTION_NUMBER = r"(?i)\boption\s*([0-9]+)\b"
OPTION_KEY = r"(?i)^option\s+([1-9][0-9]*)$"
RELEASE_MENTION = r"(?i)\b(?:according\s+to\s+|under\s+|in\s+|for\s+|from\s+|within\s+)?(?:the\s+)?(?:3GPP\s+)?Release\s+\d+\b"
TRAILING = r"(?i)(?:\b(?:according\s+to|under|in|for|from|within|of|the|context\s+of|reference\s+to)\b\s*)+$"
ANSWER_FORMAT = (
    "Required response format: exactly `Option N`, with N replaced by one listed option number. "
    "Output only that label: no explanation, reasoning, punctuation, Markdown, code fence, option text, "
    "or second option. Valid response example: `Option 1`."
)
STRICT_INSTRUCTION = (
    "Choose the correct option using only the retrieved 3GPP context. Your entire response is "
    "machine-scored: return exactly one plain-text label `Option N`, with N replaced by one listed "
    "option number. Output nothing else: no explanation, reasoning, punctuation, Markdown, code "
    "fence, option text, or second option."
)
OPEN_INSTRUCTION = "Answer the question using only the retrieved 3GPP context when it is relevant. State uncertainty when the context is insufficient."
CATEGORIES = ("Standards specifications", "Standards overview")
FACETS = 4
PUNCTUATION = r"""[!()\-\[\]{};:'"\\,<>./?@#$%^&*_~]"""


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def query_terms(text: Column) -> Column:
    """Distinct usable tokens in first-seen order: no tags, stopwords or single characters."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), RELEASE_TAG, " ")
    return F.array_distinct(F.filter(tokens(bare), lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS)))


def lexical_query(text: Column) -> Column:
    """Quoted terms joined by OR; null without any."""
    return F.nullif(F.array_join(F.transform(query_terms(text), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR "), F.lit(""))


def extract_option(text: Column) -> Column:
    """'option N' of the first mention (N > 0), else null."""
    n = F.regexp_extract(F.coalesce(text, F.lit("")), OPTION, 1)
    return F.when(n != "", F.concat(F.lit("option "), n))


def option_number(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), OPTION_NUMBER, 1).try_cast("bigint")


def scored(predicted: Column, expected: Column) -> Column:
    """Null without an expected answer; a missing prediction is wrong."""
    return F.when(expected.isNotNull(), predicted.eqNullSafe(expected))


def release(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), RELEASE_TAG, 1).try_cast("bigint")


def vocabulary_form(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), PUNCTUATION, "")


def vocabulary_words(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(text, PUNCTUATION, "")), r"\s+"), lambda w: w != "")


def document_id(path: Column) -> Column:
    """The last segment of a path with either slash; null if empty."""
    return F.nullif(F.substring_index(F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), "/+$", ""), "/", -1), F.lit(""))


def expansion_key(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ")


def slug(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("run"))


def category(text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("Uncategorized"))


def shown(c: Column) -> Column:
    """A value as prompts show it; a missing one is None."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def seed_header(series: Column, document: Column, heading: Column, chunk: Column) -> Column:
    return F.format_string("[series=%s; document=%s; heading=%s; chunk_id=%s]", *map(shown, (series, document, heading, chunk)))


def citation_header(series: Column, document: Column, heading: Column, chunk: Column, depth: Column, parent: Column) -> Column:
    """What stands above a cited block: where it is from, and the way that led to it."""
    form = "[Referenced candidate; series=%s; document=%s; heading=%s; chunk_id=%s; citation_depth=%s; cited_by=%s; path=%s -> %s]"
    return F.format_string(form, *map(shown, (series, document, heading, chunk, depth, parent, parent, chunk)))


def answer_prompt(question: Column, options: Column) -> Column:
    """The question, its options (array of n and text) by number, and the form that the answer must have."""
    lines = F.transform(F.array_sort(options), lambda o: F.format_string("Option %d: %s", o["n"], o["text"]))
    return F.concat(question, F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n\n" + ANSWER_FORMAT))


def full_prompt(question: Column, contexts: Column, strict: bool) -> Column:
    """What the answering model reads; contexts are an array of blocks."""
    head = STRICT_INSTRUCTION if strict else OPEN_INSTRUCTION
    return F.concat(F.lit(head + "\n\nQuestion:\n"), question, F.lit("\n\nRetrieved context:\n"), F.array_join(contexts, "\n\n"))


def without_tag(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"\s*{RELEASE_TAG}\s*", " "))


def clean_facet(text: Column) -> Column:
    """Without release tags and mentions, words that led to them, and edges of punctuation."""
    bare = F.regexp_replace(F.regexp_replace(text, rf"\s*{RELEASE_TAG}\s*", " "), RELEASE_MENTION, " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(bare, TRAILING, ""), r"\s+", " "), F.lit(" ,;:-"))


def facets(reply: Column, question: Column) -> Column:
    """At most FACETS distinct cleaned texts of the reply's list, in order; the question without tag if there are none."""
    found = F.try_variant_get(F.try_parse_json(reply), "$.facets", "array<variant>")
    texts = F.transform(F.filter(found, lambda f: F.schema_of_variant(f) == "STRING"), lambda f: F.try_variant_get(f, "$", "string"))
    kept = F.slice(F.array_distinct(F.filter(F.transform(texts, clean_facet), lambda f: f != "")), 1, FACETS)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(without_tag(question)))


def known_category(text: Column) -> Column:
    return F.when(text.isin(*CATEGORIES), text)


def percentage(value: Column) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.2f%%", value))


def natural_order(question_id: Column) -> Column:
    """Sorts ids by the number at their end; ids without one come last, as text."""
    number = F.element_at(F.split(F.trim(question_id), r"\s+"), -1).try_cast("bigint")
    return F.struct(number.isNull().alias("text"), number.alias("number"), question_id.alias("id"))


def output_name(stem: str, limit: int | None = None, reverse: bool = False) -> str:
    """Name of a run over part of the questions."""
    part = "" if limit is None else f"-tail{limit}" if reverse else f"-head{limit}"
    return stem + (part or "-reverse" * reverse)
