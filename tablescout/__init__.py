"""Statistics, profiles, charts, pivots and row views of a table, on Spark."""

from .operators.charts import chart_avg, chart_histogram, chart_pie, chart_stacked, chart_sum
from .operators.distribution import bin_distribution, histogram, value_distribution
from .operators.filters import (
    DrillSpec,
    FilterSpec,
    RangeSpec,
    distinct_values,
    drill_filter,
    drill_result,
    filter_result,
    measure_ranges,
    where_contains,
    where_in,
    where_range_text,
    where_ranges,
)
from .operators.generate import ColumnRule, generate, synthesize
from .operators.grid import RankIndex, grid_order, next_page, page, project, row_count, sort_result, with_places
from .operators.percentiles import percentiles
from .operators.pivot import collapse, pivot, pivot_keys, pivot_leaves, pivot_long
from .operators.profile import base_metrics, profile, profile_dataset
from .operators.quality import (
    duplicate_keys,
    duplicate_rows,
    duplicated_key_values,
    iqr_outliers,
    pattern_scan,
    pattern_total,
)
from .operators.quickstats import null_counts, quick_date, quick_num, quick_stats, quick_top, round_measures
from .operators.report import dataset_report, report_of, report_sections
from .operators.values import value_counts
from .sources.delimited import Dataset, file_facts, read_dataset
from .sources.dictionary import (
    Dictionary,
    Field,
    missing_headers,
    parse_field_record,
    parse_lines,
    read_dictionary_table,
    read_dictionary_text,
    read_generator_spec,
    roles,
    validate_dictionary,
)
from .sources.export import (
    export_csv,
    export_pivot,
    export_tsv,
    formatted,
    formatted_pivot,
    profile_digest,
    write_synthetic,
)

__all__ = sorted(n for n, v in list(globals().items()) if callable(v) and not n.startswith("_"))
