"""Column-level helpers (scalar functions, section X of the survey)."""

from tallyspark.functions.calendar import (  # noqa: F401
    iso_week,
    iso_year,
    last_week_end,
    month_back,
    parse_invoice_datetime,
    weekday_sun1,
    yyyy_mm_label,
)
from tallyspark.functions.keys import key_text, surrogate_key  # noqa: F401
from tallyspark.functions.numeric import money, ratio, round_ratio, trunc0  # noqa: F401
from tallyspark.functions.text import (  # noqa: F401
    concat_skip_nulls,
    fold_homoglyphs,
    like_any,
    occurrences,
    rtrim_chars,
)
