"""Stage builds and the registered queries."""

from . import q_evidence, q_operations, q_profile  # noqa: F401
from .registry import REGISTRY  # noqa: F401
