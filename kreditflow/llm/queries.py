"""The registered queries of this subpackage and the SQL statements that check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kreditflow.llm.op1_bpe import op1_bpe
from kreditflow.llm.op10_language import op10_language
from kreditflow.llm.op11_pivots import op11_pivots
from kreditflow.llm.op12_centroids import op12_centroids
from kreditflow.llm.op13_whitening import op13_whitening
from kreditflow.llm.op2_packing import op2_packing
from kreditflow.llm.op3_minhash import op3_minhash
from kreditflow.llm.op4_warc import SQL as WARC_SQL
from kreditflow.llm.op4_warc import op4_warc
from kreditflow.llm.op5_imatch import op5_imatch
from kreditflow.llm.op6_lines import SQL as LINES_SQL
from kreditflow.llm.op6_lines import op6_lines
from kreditflow.llm.op7_quality import SQL as QUALITY_SQL
from kreditflow.llm.op7_quality import op7_quality
from kreditflow.llm.op8_suffix_tree import op8_suffix_tree
from kreditflow.llm.op9_counts import op9_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_packing": op2_packing,
    "op3_minhash": op3_minhash,
    "op4_warc": op4_warc,
    "op5_imatch": op5_imatch,
    "op6_lines": op6_lines,
    "op7_quality": op7_quality,
    "op8_suffix_tree": op8_suffix_tree,
    "op9_counts": op9_counts,
    "op10_language": op10_language,
    "op11_pivots": op11_pivots,
    "op12_centroids": op12_centroids,
    "op13_whitening": op13_whitening,
}
SQL: dict[str, str] = {"op4_warc": WARC_SQL, "op6_lines": LINES_SQL, "op7_quality": QUALITY_SQL}
