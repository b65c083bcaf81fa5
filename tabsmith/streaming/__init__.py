from tabsmith.streaming.apply_stream import apply_fitted_stream, score_stream  # noqa: F401
