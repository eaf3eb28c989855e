"""Metric catalogue and weighting profiles."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, LongType, StructField, StructType

# Metric names, their folder aggregation, and whether higher is riskier.
METRICS: list[tuple[str, str, bool]] = [
    ("loc", "sum", True),
    ("complexity", "max", True),
    ("function_count", "sum", True),
    ("file_size", "sum", True),
    ("file_count", "sum", True),
    ("comment_lines", "sum", False),
    ("comment_density", "derived", False),
    ("max_nesting_depth", "max", True),
    ("average_function_length", "weighted average", True),
    ("parameter_count", "sum", True),
    ("todo_count", "sum", True),
    ("classes_count", "sum", True),
    ("tsx_nesting_depth", "max", True),
    ("tsx_render_branching_count", "sum", True),
    ("tsx_react_use_effect_count", "sum", True),
    ("tsx_anonymous_handler_count", "sum", True),
    ("tsx_prop_count", "sum", True),
    ("ts_any_usage_count", "sum", True),
    ("ts_ignore_count", "sum", True),
    ("ts_import_coupling_count", "sum", True),
    ("tsx_hardcoded_string_volume", "sum", True),
    ("tsx_duplicated_string_count", "sum", True),
    ("ts_type_interface_count", "sum", True),
    ("ts_export_count", "sum", True),
    ("python_import_count", "sum", True),
    ("md_data_url_count", "sum", True),
]

#: Metrics that are fractions; all others are whole numbers.
FLOATS = {"complexity", "last_modified", "comment_density", "average_function_length"}
#: Every field of a node, the two that the catalogue does not rank included.
FIELDS = [m for m, _, _ in METRICS] + ["last_modified", "gitignored_count"]

# Weight of each metric in each profile.
PROFILES: dict[str, dict[str, float]] = {
    "general": {"complexity": 1.5, "loc": 1.1, "todo_count": 0.9, "max_nesting_depth": 1.0, "parameter_count": 0.6, "ts_any_usage_count": 0.8, "ts_ignore_count": 0.9, "ts_import_coupling_count": 0.8, "tsx_render_branching_count": 0.9, "python_import_count": 0.5, "md_data_url_count": 0.4},
    "frontend": {"complexity": 1.0, "loc": 0.8, "tsx_nesting_depth": 1.2, "tsx_render_branching_count": 1.5, "tsx_anonymous_handler_count": 1.0, "tsx_prop_count": 1.0, "tsx_hardcoded_string_volume": 0.8, "tsx_duplicated_string_count": 0.9, "ts_import_coupling_count": 0.9},
    "backend": {"complexity": 1.6, "loc": 1.0, "max_nesting_depth": 1.2, "parameter_count": 0.9, "classes_count": 0.6, "todo_count": 0.8, "python_import_count": 0.9},
    "typescript": {"complexity": 1.0, "ts_any_usage_count": 1.4, "ts_ignore_count": 1.4, "ts_import_coupling_count": 1.1, "ts_export_count": 0.7, "ts_type_interface_count": 0.5, "tsx_render_branching_count": 1.0},
    "python": {"complexity": 1.4, "loc": 1.0, "max_nesting_depth": 1.0, "parameter_count": 0.8, "python_import_count": 1.2},
    "docs": {"loc": 0.8, "md_data_url_count": 1.6, "todo_count": 0.6},
}


def metric_type(name: str):
    return DoubleType() if name in FLOATS else LongType()


def metric_fields() -> list[StructField]:
    return [StructField(m, metric_type(m)) for m in FIELDS]


def node_schema() -> StructType:
    """One row per folder, file or scope; children refer to their parent."""
    text = ["node_id string", "parent_id string", "preorder long", "depth int", "node_type string", "name string", "path string", "start_line long", "end_line long"]
    out = StructType()
    for t in text:
        out = out.add(*t.split())
    for f in metric_fields():
        out = out.add(f)
    return out


def profile(name: str) -> dict[str, float]:
    """Weights of a profile; unknown names get the general one."""
    return PROFILES.get(name, PROFILES["general"])


def unit_profile(metrics: list[str]) -> dict[str, float]:
    """Weights for a list of metrics chosen by the user."""
    return dict.fromkeys(metrics, 1.0)
