"""The queries of this folder, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import base, decontaminate, interpolate, ranked
from .licenses import op7_license_scan
from .mixing import op5_mixing
from .pii import op8_personal_data
from .rules import op2_quality_rules
from .runs import op11_periodic_runs
from .secrets import op9_secret_scan
from .simhash import op1_simhash
from .suffix import ORACLE as SUFFIX_ORACLE
from .suffix import op6_suffix_dedup
from .toxicity import op10_toxicity
from .trees import op3_quality_classifier

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_mixing": op5_mixing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_personal_data": op8_personal_data,
    "op9_secret_scan": op9_secret_scan,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_lm_scoring": interpolate.op12_lm_scoring,
    "op13_ranked_search": ranked.op13_ranked_search,
    "lm_base": interpolate.lm_base,
    **base.QUERIES,
}

ORACLES: dict[str, str] = {
    "op4_decontamination": decontaminate.ORACLE,
    "op6_suffix_dedup": SUFFIX_ORACLE,
    "op13_ranked_search": ranked.ORACLE,
    "lm_base": interpolate.BASE_SQL,
    **base.ORACLES,
}
