"""A join that spreads every key of its large side over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks that one key of the large side is spread over.
SALTS = 8


def salted_join(large: DataFrame, small: DataFrame, on: list[str], by: Column, how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """``large`` joined with ``small`` on the columns ``on``, each key in ``salts`` parts dealt by a hash of ``by``.

    The small side is repeated once per part, so it should hold few rows a
    key (one, for a lookup). No row is lost: every part meets all of it.
    """
    parted = large.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.array(*map(F.lit, range(salts)))))
    return parted.join(repeated, [*on, "_salt"], how).drop("_salt")
