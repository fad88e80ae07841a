"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, secrets
from .bpe import op8_bpe
from .decontaminate import op6_decontaminate
from .pii import op2_personal_data
from .quality import op9_quality
from .repeats import op4_repeats
from .secrets import op5_secrets
from .simhash import op7_simhash
from .token_counts import op10_token_counts
from .transport import op1_transport
from .url_filter import op3_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_transport": op1_transport,
        "op2_personal_data": op2_personal_data,
        "op3_url_filter": op3_url_filter,
        "op4_repeats": op4_repeats,
        "op5_secrets": op5_secrets,
        "op6_decontaminate": op6_decontaminate,
        "op7_simhash": op7_simhash,
        "op8_bpe": op8_bpe,
        "op9_quality": op9_quality,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_secrets": secrets.SQL, "op6_decontaminate": decontaminate.SQL}
