"""Column-expression helpers (all JVM-side built-ins)."""

from lookalike.functions.columns import (  # noqa: F401
    feature_columns,
    nan_to_null,
    long_to_wide_names,
    unpivot_features,
)
from lookalike.functions.stats import (  # noqa: F401
    sample_kurtosis,
    sample_skewness,
    safe_div,
)
from lookalike.functions.vectors import (  # noqa: F401
    array_dot,
    array_norm,
    unit_vector,
    vector_from_columns,
)
