from tabsmith.functions.columns import (  # noqa: F401
    categorical_columns,
    long_numeric,
    nan_to_null,
    numeric_columns,
    row_hash,
)
from tabsmith.functions.ranking import hash_rank, ordered_cumsum, ordered_rank  # noqa: F401
