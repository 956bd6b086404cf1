"""lakeloom: a Spark-native lakehouse query engine."""

from .errors import LakeError
from .sdk import Lake
from .session import get_session

__all__ = ["Lake", "LakeError", "get_session"]
