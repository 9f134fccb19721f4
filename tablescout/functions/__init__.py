"""Column expressions: safe casts, text forms and display formats."""

from .columns import (
    boolean_like,
    double_text,
    qcol,
    safe_double,
    safe_timestamp,
    text_of,
    trim_text,
)
from .formats import (
    bin_label,
    fmt_dimension,
    fmt_measure,
    round_measure,
    size_text,
    yyyymmdd,
)

__all__ = [
    "bin_label",
    "boolean_like",
    "double_text",
    "fmt_dimension",
    "fmt_measure",
    "qcol",
    "round_measure",
    "safe_double",
    "safe_timestamp",
    "size_text",
    "text_of",
    "trim_text",
    "yyyymmdd",
]
