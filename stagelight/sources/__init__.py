"""Sources: declared role schemas, fixed literal relations, role loaders."""

from .literals import course_type_dim
from .roles import (EmptyRelationError, MissingTablesError, Roles, missing_tables,
                    require_rows, require_tables)
from .schemas import DEMOGRAPHICS_ROLES, ROLE_SCHEMAS

__all__ = ["Roles", "ROLE_SCHEMAS", "DEMOGRAPHICS_ROLES", "MissingTablesError",
           "EmptyRelationError", "course_type_dim", "missing_tables", "require_rows",
           "require_tables"]
