"""Registered queries with their DuckDB equivalents."""

from fieldloom.catalogue.registry import ORACLES, QUERIES
from fieldloom.catalogue import mesh as _mesh  # noqa: F401
from fieldloom.catalogue import fields as _fields  # noqa: F401
from fieldloom.catalogue import vectors as _vectors  # noqa: F401
from fieldloom.catalogue import files as _files  # noqa: F401
