"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import functools
import io
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .fingerprints import op1_fingerprints
from .idfile import op7_token_ids
from .mixing import mixing_sql, op3_mixing
from .ngram_join import op8_ngram_join
from .packing import op2_packing
from .pii import op10_pii
from .quality_rules import op4_quality_rules
from .quality_classifier import op9_quality_classifier
from .spelling import op12_spelling_variants, spelling_sql
from .substring_dedup import op6_substring_dedup
from .turn_trie import op11_turn_trie, turn_trie_sql
from .wordpiece import op5_wordpiece_counts
from .wrapper import op13_wrapper_text

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's modules, once for an application; Spark sends the archive."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{root.name}.zip")
    Path(path).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def _shipping(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: _shipping(q) for q in (
    op1_fingerprints, op2_packing, op3_mixing, op4_quality_rules, op5_wordpiece_counts, op6_substring_dedup, op7_token_ids,
    op8_ngram_join, op9_quality_classifier, op10_pii, op11_turn_trie, op12_spelling_variants, op13_wrapper_text)}
SQL: dict[str, str] = {"op3_mixing": mixing_sql(), "op11_turn_trie": turn_trie_sql(), "op12_spelling_variants": spelling_sql()}
