"""Job parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from changelens.functions import fixed


@dataclass(frozen=True)
class JobConfig:
    """Settings of one job; every field has its own default."""

    frameworks: dict[str, str] = field(default_factory=lambda: dict(fixed.FRAMEWORKS))
    coverage_target: float = 80.0
    max_tests_per_function: int = 5
    generate_edge_cases: bool = True
    unit_pattern: str = "test_{function_name}"
    functional_pattern: str = "test_{feature_name}_e2e"
    min_lines_changed: int = 5
    include_globs: tuple[str, ...] = fixed.INCLUDE_GLOBS
    exclude_globs: tuple[str, ...] = fixed.EXCLUDE_GLOBS
    fail_on_decrease: bool = False
    min_coverage_increase: float = 0.0
    max_retries: int = 2
    cache_hours: int = 24
    preview_files: int = 10
    include_added: bool = False
    include_renames: bool = False
