"""Where the queries of this subpackage read their tables, and small shared pieces of plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str) -> Column:
    """crc32 of the id as text; queries deal their folds by it."""
    return F.crc32(F.col(column).cast("string"))


def apart(docs: DataFrame, keep: list[str], taken: tuple[str, ...]) -> tuple[DataFrame, list[str], dict[str, str]]:
    """``docs`` and ``keep`` with other names for kept columns that an operator's own have, and the way back."""
    own, used = {t.lower() for t in taken}, {c.lower() for c in docs.columns} | {t.lower() for t in taken}
    names: dict[str, str] = {}
    for c in keep:
        if c.lower() in own and c not in names:
            n = len(names)
            while f"kept_{n}" in used:
                n += 1
            used.add(f"kept_{n}")
            names[c] = f"kept_{n}"
    return docs.withColumnsRenamed(names), [names.get(c, c) for c in keep], {new: old for old, new in names.items()}
