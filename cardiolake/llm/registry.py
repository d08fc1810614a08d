"""Queries of this sub-package: one ``opN_<name>`` per operator."""

from __future__ import annotations

from .clustering import OP11_SQL, op11_centroid_clustering
from .decontaminate import OP6_SQL, op6_decontamination
from .divergence import OP13_SQL, op13_source_divergence
from .html_extract import op4_html_extraction
from .near_dedup import op3_near_dedup
from .packing import op9_packing
from .personal_data import OP12_SQL, op12_personal_data
from .quality_classifier import op2_quality_classifier
from .quality_rules import op10_quality_rules
from .secrets import op5_secret_scan
from .sharding import op7_sharding
from .suffix_dedup import op1_suffix_dedup
from .warc import OP8_SQL, op8_warc


def queries() -> dict:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_near_dedup": op3_near_dedup,
        "op4_html_extraction": op4_html_extraction,
        "op5_secret_scan": op5_secret_scan,
        "op6_decontamination": op6_decontamination,
        "op7_sharding": op7_sharding,
        "op8_warc": op8_warc,
        "op9_packing": op9_packing,
        "op10_quality_rules": op10_quality_rules,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_personal_data": op12_personal_data,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": OP6_SQL, "op8_warc": OP8_SQL, "op11_centroid_clustering": OP11_SQL, "op12_personal_data": OP12_SQL, "op13_source_divergence": OP13_SQL}
