"""The registered queries of this subpackage and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.chat import OP3_SQL, op3_chat_format
from siltstone.llm.decontamination import OP7_SQL, op7_decontamination
from siltstone.llm.extraction import op5_extraction
from siltstone.llm.fixity import op1_warc_fixity
from siltstone.llm.jaccard_join import op2_jaccard_join
from siltstone.llm.nearest import op10_nearest
from siltstone.llm.packing import op6_packing
from siltstone.llm.quality import op8_quality
from siltstone.llm.token_counts import op4_token_counts
from siltstone.llm.toxicity import op9_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_warc_fixity, op2_jaccard_join, op3_chat_format, op4_token_counts, op5_extraction,
        op6_packing, op7_decontamination, op8_quality, op9_toxicity, op10_nearest,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": OP3_SQL, "op7_decontamination": OP7_SQL}
