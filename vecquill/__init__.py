"""PySpark-native vector collections: exact and approximate search over
versioned parquet segments, and (in the optional subpackage ``llm``) operators
for preparing training data."""

from .catalog import IndexCatalog
from .engine import Params, VectorEngine
from .functions.distance import dot, dot_batch, dot_mat_vec, dot_value, l2_sqr, l2_sqr_batch, l2_sqr_mat_vec, l2_sqr_value
from .operators.knn import all_knn, all_knn_batch, brute_knn_batch, knn

__all__ = [
    "IndexCatalog", "Params", "VectorEngine", "all_knn", "all_knn_batch", "brute_knn_batch", "dot", "dot_batch", "dot_mat_vec", "dot_value", "knn", "l2_sqr",
    "l2_sqr_batch", "l2_sqr_mat_vec", "l2_sqr_value",
]
