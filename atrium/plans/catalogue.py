"""All queries over the driver's tables, with their SQL; each module adds its own on import."""

from . import documents as documents
from . import solids as solids
from .queries import ORACLE_SQL as ORACLE_SQL
from .queries import QUERIES as QUERIES
from .queries import flagship as flagship
