"""Errors with a code, as `[code] message`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the codes that callers match on
CODES = (
    "file_not_found", "file_exists", "invalid_path", "unsupported_format", "parse_error", "index_out_of_range",
    "sheet_not_found", "range_too_large", "merge_field_missing", "io_error", "internal_error", "vba_project_missing",
    "vba_project_locked", "vba_parse_error", "module_not_found", "procedure_not_found", "graph_too_large",
    "invalid_render_option",
)


class FoliateError(ValueError):
    """A refused request; `code` is one of CODES."""

    def __init__(self, code: str, message: str):
        if code not in CODES:
            raise KeyError(code)
        super().__init__(f"[{code}] {message}")
        self.code = code


def fail_when(condition: Column, code: str, message: Column | str, value: Column) -> Column:
    """value, or the task fails with the coded error where condition holds."""
    text = F.concat(F.lit(f"[{code}] "), F.lit(message) if isinstance(message, str) else message)
    return F.when(condition, F.raise_error(text)).otherwise(value)
