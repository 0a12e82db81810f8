"""All registered queries of the geospatial engine."""

from __future__ import annotations

from . import crs_queries as _crs  # noqa: F401  registers
from . import grid_queries as _grid  # noqa: F401
from . import format_queries as _format  # noqa: F401
from . import overlay_queries as _overlay  # noqa: F401
from . import relation_queries as _relation  # noqa: F401
from .planar_queries import ORACLE, QUERIES  # noqa: F401
