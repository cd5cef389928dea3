"""All registered queries of the library, less those of the llm subpackage."""

from . import manifest_queries, mask_queries, metric_queries, run_queries, scalar_queries, source_queries, stream_queries, telemetry_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
