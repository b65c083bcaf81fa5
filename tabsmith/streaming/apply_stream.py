"""Fitted transform steps and batch scoring on a Structured Streaming source.

The reference has no streaming engine; its fitted steps are stateless expressions, so they
apply unchanged to a ``readStream`` frame: statistics are taken from a static fit frame (one
small aggregate per step), per-category mappings become stream-static joins, and every
micro-batch is written with ``foreachBatch`` (idempotent per batch id, so a restarted query
after an executor or driver failure rewrites the same batch folder).
Steps that need the whole table at once (hold-out split, keep-first de-duplication) are refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tabsmith.operators.steps import apply_steps

STREAM_UNSAFE = {"train_test_split", "drop_duplicates"}


def apply_fitted_stream(stream: DataFrame, steps: Sequence[dict], fit_on: DataFrame, fit_scope: str = "all") -> DataFrame:
    """Lazy streaming DataFrame = ``steps`` fitted on the static ``fit_on`` and applied to ``stream``."""
    bad = [s.get("type") for s in steps if s.get("type") in STREAM_UNSAFE]
    if bad:
        raise ValueError(f"steps {bad} need the whole table and cannot run on a stream")
    return apply_steps(stream, steps, fit_scope, fit_on=fit_on)


def score_stream(stream: DataFrame, model, assembler=None) -> DataFrame:
    """X10 on a stream: assemble features (optional) and transform with a fitted model."""
    df = assembler.transform(stream) if assembler is not None else stream
    return model.transform(df)


def write_batches(stream: DataFrame, out_dir: str, checkpoint_dir: str, trigger_once: bool = True):
    """Start the query: each micro-batch is written to ``out_dir/batch=<id>`` (overwrite, so a
    replayed batch after a failure produces the same output)."""
    def sink(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_dir)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
