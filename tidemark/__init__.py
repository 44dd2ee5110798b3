"""tidemark — layered change-stream analytics as Spark DataFrame jobs.

Every operator is a plain function ``f(df, ..., as_of=..., **params) -> DataFrame``
so the same code runs over a full snapshot (batch) and inside a
Structured Streaming ``foreachBatch`` body (incremental).
"""

from tidemark.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
