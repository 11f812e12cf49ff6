"""Identifier terms: tokens, derived terms, literals, ids and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Identifier tokens, quoted literals and mentions.
TOKEN = r"[A-Z]+(?![a-z])|[A-Z][a-z]*|[a-z]+|[0-9]+"
LITERAL = r"'([^'\"\r\n]+)'|\"([^'\"\r\n]+)\""
MENTION = r"`([^`\n]+)`"
RAISES = r"\b(raise|throw)\b"
WORD = r"[A-Za-z0-9_]+"


def split_tokens(term: Column) -> Column:
    """Runs of digits, capitals and capitalised or lower-case words."""
    return F.regexp_extract_all(term, F.lit(TOKEN), F.lit(0))


def adjacent_pairs(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat(F.get(tokens, i), F.get(tokens, i + 1)))).otherwise(F.array().cast("array<string>"))


def other_number(term: Column) -> Column:
    """Singular of a plural and plural of a singular."""
    cut = lambda k: F.substring(term, F.lit(1), F.length(term) - k)
    return F.when(term.endswith("ies"), F.concat(cut(3), F.lit("y"))).when(term.endswith("s") & ~term.endswith("ss"), cut(1)).when(
        term.rlike("(?i)[^aeiou]y$") & term.endswith("y"), F.concat(cut(1), F.lit("ies"))).otherwise(F.concat(term, F.lit("s")))


def strip_affixes(term: Column, prefixes, suffixes) -> Column:
    """What is left after each prefix, its first letter lowered, then before each suffix."""
    def after(p):
        rest = F.substring(term, F.lit(len(p) + 1), F.length(term))
        return F.when(term.startswith(p) & (F.length(term) > len(p)), F.concat(F.lower(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest))))

    def before(s):
        return F.when(term.endswith(s) & (F.length(term) > len(s)), F.substring(term, F.lit(1), F.length(term) - len(s)))
    made = [after(p) for p in prefixes] + [before(s) for s in suffixes]
    return F.filter(F.array(*made), lambda x: x.isNotNull()) if made else F.array().cast("array<string>")


def derive_terms(term: Column, transforms, min_length: int) -> Column:
    """Array of (term, rule) in the order of the transforms; the first transform to make a term owns it."""
    tokens = split_tokens(term)
    makers = {
        "split-case": lambda t: tokens, "token-adjacent-pairs": lambda t: adjacent_pairs(tokens), "normalize-case": lambda t: F.array(F.lower(term)),
        "plural-singular": lambda t: F.array(other_number(term)), "strip-affix": lambda t: strip_affixes(term, t.prefixes, t.suffixes)}

    def tagged(t):
        return F.transform(makers[t.id](t), lambda x: F.struct(x.alias("term"), F.lit(t.id).alias("rule")))
    every = F.concat(*[tagged(t) for t in transforms]) if transforms else F.array().cast("array<struct<term:string,rule:string>>")
    fit = F.filter(every, lambda x: (x["term"] != term) & (F.length(x["term"]) >= min_length))
    return F.filter(fit, lambda x, i: F.array_position(F.transform(fit, lambda y: y["term"]), x["term"]) == i + 1)


def clue_term(term: Column, min_length: int) -> Column:
    """The stripped term, or null if it is no clue: line breaks inside or too short."""
    bare = F.regexp_replace(term, r"(?U)^\s+|\s+$", "")
    return F.when((F.length(bare) >= max(1, min_length)) & ~bare.rlike(r"[\r\n]"), bare)


def short_hash(*pieces: Column) -> Column:
    """First sixteen hexadecimal digits of SHA-256 over the pieces between bars."""
    return F.substring(F.sha2(F.concat_ws("|", *pieces), 256), 1, 16)


def render_occurrences(occurrences: Column) -> Column:
    return F.array_join(F.transform(occurrences, lambda o: F.concat_ws(":", o["file_path"], o["line"].cast("string"), o["matched_text"])), "\n")


def occurrence_digest(occurrences: Column) -> Column:
    rows = F.transform(occurrences, lambda o: F.concat_ws("|", o["file_path"], o["line"].cast("string"), o["col"].cast("string"), o["matched_text"], o["context"], o["enclosing_node_id"]))
    return F.sha2(F.array_join(rows, "\n"), 256)


def literals(text: Column) -> Column:
    """Contents of quoted literals on one line without quotes inside."""
    return F.transform(F.regexp_extract_all(text, F.lit(LITERAL), F.lit(0)), lambda m: F.substring(m, F.lit(2), F.length(m) - 2))
