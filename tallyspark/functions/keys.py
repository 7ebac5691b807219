"""Surrogate keys over a column list (the shape of dbt_utils.generate_surrogate_key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token used for NULL fields and the field separator.
NULL_TOKEN = "_dbt_utils_surrogate_key_null_"
SEPARATOR = "-"


def key_text(col: Column, dtype: T.DataType | None = None) -> Column:
    """Text form of a key field.

    Floating-point fields go through a decimal first so that large values never
    print in scientific notation (``1.0E7``); the text is then engine-neutral.
    """
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return col.cast("decimal(38,4)").cast("string")
    return col.cast("string")


def surrogate_key(df: DataFrame, cols: list[str]) -> Column:
    """md5 over the '-'-joined text of ``cols``; NULLs become a fixed token."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = [F.coalesce(key_text(F.col(c), types.get(c)), F.lit(NULL_TOKEN)) for c in cols]
    return F.md5(F.concat_ws(SEPARATOR, *parts))


def key_bytes(key: Column) -> Column:
    """A key in half the bytes, for joins and groups: equal exactly where the texts are equal, null where they are null.

    The 32 hexadecimal digits of a surrogate key become 16 bytes; any other text stays whole behind 17 zero bytes.
    """
    other = F.concat(F.lit(bytes(17)), F.encode(key, "UTF-8"))
    return F.when(key.rlike("\\A[0-9a-f]{32}\\z"), F.unhex(key)).otherwise(other)
