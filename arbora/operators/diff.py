"""Keyed comparison of two snapshots: what was added, removed and changed, field by field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields that a comparison of views looks at.
READABLE_FIELDS = ("read_cost.token_estimate", "flags", "start_line", "end_line")
QUERY_FIELDS = ("arrival_node_ids", "output_tokens", "excluded", "origin_node_ids", "occurrence_digest", "clue_kinds", "rule_id", "source_terms")
LINK_FIELDS = ("to_node_ids", "specificity", "query_id", "evidence_file", "evidence_line", "resolution", "candidate_node_ids")


def _text(column):
    """A comparable form of any value: JSON, null for null."""
    return F.get_json_object(F.to_json(F.struct(column.alias("v"))), "$.v")


def diff(before: DataFrame, after: DataFrame, fields, key: str = "id") -> DataFrame:
    """id, status (added, removed or changed) and fields: array of (name, before, after), by name.

    One full outer join on the key; only the listed fields are compared, nulls equal."""
    def side(df, tag):
        return df.select(F.col(key).alias("id"), F.lit(True).alias(f"in_{tag}"), F.struct(*[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]).alias(tag))
    joined = side(before, "b").join(side(after, "a"), "id", "full_outer")
    changes = F.array(*[F.when(~F.col(f"b.f{i}").eqNullSafe(F.col(f"a.f{i}")), F.struct(F.lit(f).alias("field"), _text(F.col(f"b.f{i}")).alias("before"), _text(F.col(f"a.f{i}")).alias("after")))
                        for i, f in sorted(enumerate(fields), key=lambda x: x[1])])
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    listed = F.when(both, F.filter(changes, lambda c: c.isNotNull()))
    status = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(F.size(listed) > 0, "changed")
    return joined.select("id", status.alias("status"), F.coalesce(listed, F.array().cast("array<struct<field:string,before:string,after:string>>")).alias("fields")).filter("status is not null")


def diff_views(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The three sections of a view: readable_nodes, query_nodes, framework_links."""
    fields = {"readable_nodes": READABLE_FIELDS, "query_nodes": QUERY_FIELDS, "framework_links": LINK_FIELDS}
    return {name: diff(before[name], after[name], f) for name, f in fields.items()}
