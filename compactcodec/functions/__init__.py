"""Column functions: native expressions where the shape is known, Arrow-batched kernels where it is not."""

from compactcodec.functions.codec import column_ranges, derive_schema, from_cbin, from_ctext, from_ctext_json, infer_schema, is_valid_ctext, string_table, to_cbin, to_ctext
from compactcodec.functions.columns import canonical_number, canonical_numbers, cells_by_name, escape_text, estimate_size, has_native_object, is_bare, line_type, looks_numeric, number_text, object_text, parse_cell, parse_object, quote_key_text, quote_text, row_line, split_cells, trim_space, unescape_text, utf8_length

__all__ = ["canonical_number", "canonical_numbers", "cells_by_name", "looks_numeric", "column_ranges", "escape_text", "string_table", "derive_schema", "estimate_size", "has_native_object", "object_text", "parse_object", "from_cbin", "from_ctext", "from_ctext_json", "infer_schema", "is_bare", "is_valid_ctext", "line_type", "number_text", "parse_cell", "quote_key_text", "quote_text", "row_line", "split_cells", "to_cbin", "to_ctext", "trim_space", "unescape_text", "utf8_length"]
