"""Registered queries over the shared tables, each beside the DuckDB SQL that must give the same rows.

Queries run over whole tables.  Where the tables lack something that an operator needs (pages with headings, chunk rows,
answers with citations), whole tables are mapped onto it by a projection that the SQL repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from velith.plans.catalog import answers, evaluation, relational, retrieval, text

MODULES = (text, retrieval, relational, answers, evaluation)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op_")}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
