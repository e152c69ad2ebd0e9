"""Spark-native materialization of RDF graphs from declarative mappings."""

from .api import execute, materialize
from .mapping.model import MappingError, UnsupportedMapping

__all__ = ["MappingError", "UnsupportedMapping", "execute", "materialize"]
