"""Schemas of the engine's tables. Presentation fields live apart from the graph in ``NODE_STYLE``."""

from __future__ import annotations

SPAN = "struct<file_path:string,start_line:int,end_line:int,start_col:int,end_col:int>"
COST = "struct<token_estimate:bigint,char_count:bigint,line_count:bigint>"
FILES = "path string, content string"
NODES = (f"id string, label string, kind string, category string, language string, span {SPAN}, cost {COST}, signature string, docstring string, "
         "exported boolean, symbol_path string, display_label string, flags array<string>, provenance string, metadata string, ordinal bigint")
EDGES = (f"from_id string, to_id string, relation string, confidence string, resolution string, evidence {SPAN}, candidates array<string>, weight double, metadata string, ordinal bigint")
NODE_STYLE = "id string, shape string, size int, color string, title string"
READABLE = f"id string, file_path string, symbol_id string, label string, kind string, start_line int, end_line int, read_cost {COST}, flags array<string>"
OCCURRENCE = "struct<file_path:string,line:int,col:int,matched_text:string,context:string,enclosing_node_id:string>"
QUERY_NODES = (f"id string, term string, kind string, clue_kinds array<string>, origin_node_ids array<string>, rule_id string, source_terms array<string>, occurrences array<{OCCURRENCE}>, "
               "occurrence_digest string, arrival_node_ids array<string>, output_tokens bigint, excluded boolean, exclusion_reason string")
FRAMEWORK_LINKS = ("id string, from_node_id string, rule_id string, specificity string, resolution string, to_node_ids array<string>, candidate_node_ids array<string>, "
                   "query_id string, evidence_file string, evidence_line int")

#: Fixed values of the wire format.
ARCHITECTURE_VERSION, VIEW_VERSION = "5", "2"
CONFIDENCES = ("static_certain", "static_inferred", "framework_inferred", "dynamic_required")
RESOLUTIONS = ("exact", "unique_name", "ambiguous", "unresolved")
KINDS = ("package", "module", "file", "class", "interface", "enum", "type_alias", "function", "method", "constant", "field", "configuration")
FLAGS = ("dynamic_import", "dynamic_attr", "dynamic_eval", "reexport", "ambiguous_name", "generated", "vendored", "test")
