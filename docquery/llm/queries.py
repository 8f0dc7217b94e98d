"""The registered queries of this subpackage and their SQL.

All modules are imported here, at the head: where a package that one of them needs is
missing, importing this module fails, and the entry point leaves the subpackage out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from docquery.llm import alignment, bpe, chat, embeddings, filter_audit, licenses, mixing, pieces, pii, quality, sharding, simhash, toxicity

#: Each module names its query in QUERY and has ``query(spark, sf_dir)``; ORACLE_SQL is its DuckDB SQL, or None.
MODULES = (chat, bpe, sharding, mixing, quality, simhash, embeddings, pii, toxicity, licenses, filter_audit, pieces, alignment)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.QUERY: m.query for m in MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {m.QUERY: m.ORACLE_SQL for m in MODULES if m.ORACLE_SQL}
