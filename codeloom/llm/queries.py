"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, quality, substring_dedup
from .classifier import op8_quality_classifier
from .decontaminate import op2_decontamination
from .licenses import op6_license_scan
from .line_dedup import op10_line_dedup
from .near_dedup import op4_near_dedup
from .packing import op3_packing
from .quality import op5_quality_rules
from .substring_dedup import op7_substring_dedup
from .token_counts import op9_token_counts
from .token_output import op1_token_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_decontamination": op2_decontamination,
    "op3_packing": op3_packing,
    "op4_near_dedup": op4_near_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_license_scan": op6_license_scan,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_token_counts": op9_token_counts,
    "op10_line_dedup": op10_line_dedup,
}

ORACLES: dict[str, str] = {
    "op2_decontamination": decontaminate.ORACLE,
    "op5_quality_rules": quality.ORACLE,
    "op7_substring_dedup": substring_dedup.ORACLE,
}
