"""A matrix engine on Spark: stored dense and sparse matrices, selections, alignment by name, and planned batches.

>>> import matrixloom as ml
>>> data = ml.register(spark, "sample", key="X")            # doctest: +SKIP
>>> plan = ml.compile(data, [3, 1, 3], batch_size=2)        # doctest: +SKIP
>>> for batch in plan.prefetch(): ...                       # doctest: +SKIP
"""

from .functions.errors import error_kind
from .functions.types import DTYPES, INDEX_DTYPES, dtype, is_index_dtype, is_value_dtype, promotion
from .operators.matrix import CsrFrame, DenseFrame, csr_from_arrays, dense_from_numpy, storable
from .operators.names import build_feature_map, locate_names
from .operators.partition import BLOCK_BUDGET as DEFAULT_BLOCK_BUDGET
from .operators.partition import CHUNK_BUDGET as DEFAULT_CHUNK_BUDGET
from .operators.partition import integerize_matrix
from .plans.config import IoMergeConfig, PlanConfig, ResourceLimits, SessionConfig
from .plans.output import OutputSpec
from .plans.plan import Plan, compile, distributed_prefetch, planned, prefetch  # noqa: A004
from .plans.stats import PlanStats, RuntimeStats
from .sources.container import Container, Dataset, RowRef, list_keys, read_container, read_feature_names, read_obs_names, register, write_container
from .sources.options import DEFAULT_READ_LIMITS, DEFAULT_WRITE_OPTIONS, Codec, ReadLimits, WriteOptions
from .sources.store import FORMAT as FORMAT_NAME
from .sources.store import VERSION as FORMAT_VERSION
from .sources.store import Store, open_csr, open_dense, open_store, write, write_csr, write_csr_arrays, write_dense
from .streaming.session import DistributedSession, Prefetch, Session

__version__ = "0.1.0"
