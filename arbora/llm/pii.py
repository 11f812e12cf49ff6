"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score.

All steps are native expressions on one row, so there is no shuffle. Spans are code points, end exclusive.
The patterns use possessive quantifiers and start only where a run starts, which gives the same leftmost
matches in linear time on texts without spaces.

Defined cases: null text counts as empty; an empty text has no spans and the hash of an empty string; rows
that repeat an id are scanned each; extra columns are ignored; very long texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_runs, let

#: Patterns of the kinds, in the order in which ties of a start are listed.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\x20]?[:=][\x20]?[\"']?[a-z0-9_/+.-]{16,}[\"']?",
}
BASE = ("email", "ip", "card", "phone")
#: What a text must contain before a kind's pattern runs over it.
GATES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    "secret": lambda t: t.rlike(r"(?i)(?:token|secret|passw|api[_-]?key|access[_-]?key)"),
}
#: Score of a confirmed span, and words that raise or lower it within ``WINDOW`` code points before it.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "secret": 0.8}
RAISE = {
    "email": r"(?i)mail|contact|write", "ip": r"(?i)\bip\b|host|server|addr", "card": r"(?i)card|visa|credit|pay|account",
    "phone": r"(?i)phone|tel|call|mobile|fax", "iban": r"(?i)iban|bank|transfer|konto", "secret": r"(?i)auth|bearer|login|key",
}
LOWER = r"(?i)example|sample|test|dummy|version|order|serial"
WINDOW = 40


def luhn(digits: Column) -> Column:
    """Luhn's check over a string of digits."""
    def step(acc, d):
        twice = d * (1 + acc["k"])
        return F.struct((acc["s"] + twice - F.when(twice > 9, 9).otherwise(0)).alias("s"), (1 - acc["k"]).alias("k"))
    marks = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("k"))
    return F.aggregate(F.filter(marks, lambda d: d.isNotNull()), zero, step, lambda acc: acc["s"]) % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 7064 check of an account number without spaces: first four to the end, letters as 10 to 35."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(acc, c):
        v = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97
    return F.aggregate(chars, F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        bare = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(False)
    return F.lit(True)


def _spans(text: Column, kind: str, order: int) -> Column:
    """Confirmed spans of a kind: array of (start, ord, end, kind, score)."""
    pattern = PATTERNS[kind]
    def located(found):
        def with_pieces(pieces):
            gaps = F.zip_with(found, pieces, lambda m, p: (F.length(p) + F.length(m)).cast("bigint"))
            starts = F.zip_with(fold_runs(gaps), pieces, lambda s, p: s + F.length(p))
            return F.zip_with(starts, found, lambda s, m: F.struct(s.alias("s"), m.alias("m")))
        return let(F.slice(F.split(text, pattern, -1), 1, F.size(found)), with_pieces)
    all_found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)
    kept = F.filter(all_found, lambda x: _confirmed(kind, x["m"]))

    def span(x):
        near = F.substring(text, F.greatest(F.lit(1), x["s"].cast("int") - WINDOW + 1), F.least(F.lit(WINDOW), x["s"].cast("int")))
        score = F.lit(PRIOR[kind]) + F.when(near.rlike(RAISE[kind]), 0.1).otherwise(0.0) - F.when(near.rlike(LOWER), 0.2).otherwise(0.0)
        return F.struct(x["s"].alias("start"), F.lit(order).alias("ord"), (x["s"] + F.length(x["m"])).alias("end"),
                        F.lit(kind).alias("kind"), score.alias("score"), x["m"].alias("value"))
    empty = F.array().cast("array<struct<start:bigint,ord:int,end:bigint,kind:string,score:double,value:string>>")
    return F.when(GATES[kind](text), F.transform(kept, span)).otherwise(empty)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with column ``pii``: array of (start, ord, end, kind, score, value) by start, then kind."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    gate = t.rlike(r"[@+]|[0-9][\x20.-]?[0-9]|(?i:token|secret|passw|api[_-]?key|access[_-]?key)")
    kinds = [_spans(t, kind, i) for i, kind in enumerate(PATTERNS)]
    empty = F.array().cast("array<struct<start:bigint,ord:int,end:bigint,kind:string,score:double,value:string>>")
    return docs.withColumn("pii", F.when(gate, F.array_sort(F.concat(*kinds))).otherwise(empty))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``find_pii`` replaced by <kind>; of overlapping spans the first stands."""
    found = find_pii(docs, text)
    t = F.col(f"`{text}`")

    def step(acc, x):
        gap = F.substring(t, acc["at"].cast("int") + 1, (x["start"] - acc["at"]).cast("int"))
        return F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), F.concat(acc["out"], gap, F.lit("<"), x["kind"], F.lit(">")).alias("out"))).otherwise(acc)
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    done = F.aggregate("pii", zero, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"].cast("int") + 1, F.length(t))))
    return found.withColumn(text, F.when(F.size("pii") > 0, done).otherwise(t)).drop("pii")


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of a frame with ``pii``."""
    def joined(a):
        return F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda x: x["ord"] < len(BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"),
                        *[count(k) for k in PATTERNS if k not in BASE], F.round(F.coalesce(F.array_max(F.transform("pii", lambda x: x["score"])), F.lit(0.0)), 4).alias("score"))
