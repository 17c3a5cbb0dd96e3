"""The corpus operators' queries and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .interleaved import op5_media_columns
from .line_dedup import OP9_SQL, op9_line_dedup
from .near_vectors import OP3_SQL, op3_near_vectors
from .packing import op4_packing
from .periodic_runs import op13_periodic_runs
from .quality import op11_quality
from .secrets import OP8_SQL, op8_secrets
from .sentences import op2_sentencepiece
from .simhash import op10_simhash
from .source_divergence import OP12_SQL, op12_source_divergence
from .token_files import op1_token_files
from .toxicity import op6_toxicity
from .url_filters import OP7_SQL, op7_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_near_vectors": op3_near_vectors,
        "op4_packing": op4_packing,
        "op5_media_columns": op5_media_columns,
        "op6_toxicity": op6_toxicity,
        "op7_url_filters": op7_url_filters,
        "op8_secrets": op8_secrets,
        "op9_line_dedup": op9_line_dedup,
        "op10_simhash": op10_simhash,
        "op11_quality": op11_quality,
        "op12_source_divergence": op12_source_divergence,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_near_vectors": OP3_SQL, "op7_url_filters": OP7_SQL, "op8_secrets": OP8_SQL, "op9_line_dedup": OP9_SQL, "op12_source_divergence": OP12_SQL}
