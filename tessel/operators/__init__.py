"""DataFrame operators: running programs per document, checking shapes, observing shapes."""

from .documents import run_documents, run_json
from .shape_ops import check_json, check_rows, observed_shape, observed_type

__all__ = ["check_json", "check_rows", "observed_shape", "observed_type", "run_documents", "run_json"]
