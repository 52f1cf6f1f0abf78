"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op3_learned_partitions
from .langid import op9_hierarchical_langid
from .mixing import op7_subset_sum
from .neardup import OP10_SQL, op10_chosen_path
from .packing import op5_cutting_stock
from .quality import op1_pu_quality
from .sharding import OP2_SQL, op2_lpt_sharding
from .surrogates import op4_surrogates
from .tiff import op8_tiff
from .warc import OP6_SQL, op6_warc_segments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pu_quality": op1_pu_quality,
    "op2_lpt_sharding": op2_lpt_sharding,
    "op3_learned_partitions": op3_learned_partitions,
    "op4_surrogates": op4_surrogates,
    "op5_cutting_stock": op5_cutting_stock,
    "op6_warc_segments": op6_warc_segments,
    "op7_subset_sum": op7_subset_sum,
    "op8_tiff": op8_tiff,
    "op9_hierarchical_langid": op9_hierarchical_langid,
    "op10_chosen_path": op10_chosen_path,
}

ORACLE: dict[str, str] = {"op2_lpt_sharding": OP2_SQL, "op6_warc_segments": OP6_SQL, "op10_chosen_path": OP10_SQL}
