"""Token, character and line costs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4.0
#: What Python's splitlines breaks at, as one expression.
LINE_BREAKS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"


def estimate_tokens(text: Column, chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    """At least one token; code points over ``chars_per_token``, rounded up."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / chars_per_token)).cast("long")


def line_count(text: Column) -> Column:
    """Line feeds and one more; an empty text has no line."""
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def cost_for_text(text: Column, chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    return F.struct(estimate_tokens(text, chars_per_token).alias("token_estimate"), F.length(text).cast("long").alias("char_count"), line_count(text).alias("line_count"))


def split_lines(text: Column) -> Column:
    """Lines without their ends; an end at the text's end opens no further line."""
    lines = F.split(text, LINE_BREAKS, -1)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def text_for_span(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, both included, joined by line feeds. An end before the start is empty."""
    first = F.greatest(F.lit(1), start)
    return F.array_join(F.slice(split_lines(text), first, F.greatest(F.lit(0), end - first + 1)), "\n")


def cost_for_span(text: Column, start: Column, end: Column) -> Column:
    return cost_for_text(text_for_span(text, start, F.coalesce(end, start)))


def cost_multiplier(flags: Column, path: Column) -> Column:
    """Share of a node's cost that counts: none if vendored, a tenth if generated or a migration."""
    low = F.transform(F.coalesce(flags, F.array().cast("array<string>")), lambda f: F.lower(f))
    place = F.concat(F.lit("/"), F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))))
    vendored = F.array_contains(low, "vendored") | place.contains("/vendor/") | place.contains("/node_modules/")
    generated = F.array_contains(low, "generated") | F.array_contains(low, "migration") | place.contains("/migrations/") | place.contains("/alembic/versions/")
    return F.when(vendored, 0.0).when(generated, 0.1).otherwise(1.0)


def display_name(display_label: Column, label: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(display_label, F.lit("")), F.nullif(label, F.lit("")), fallback)


def node_token_cost(cost: Column, span_text: Column, label: Column, title: Column, metadata: Column) -> Column:
    """A node's own estimate if positive, else its source text's, else that of its label, title and metadata."""
    fallback = F.concat(F.lit('{"label": '), F.to_json(F.array(F.coalesce(label, F.lit("")))).substr(F.lit(2), F.length(F.to_json(F.array(F.coalesce(label, F.lit(""))))) - 2),
                        F.lit(', "title": '), F.to_json(F.array(F.coalesce(title, F.lit("")))).substr(F.lit(2), F.length(F.to_json(F.array(F.coalesce(title, F.lit(""))))) - 2),
                        F.lit(', "metadata": '), F.coalesce(metadata, F.lit("{}")), F.lit("}"))
    own = cost["token_estimate"]
    return F.when(own > 0, own).when(F.coalesce(span_text, F.lit("")) != "", estimate_tokens(span_text)).otherwise(estimate_tokens(fallback)).cast("long")
