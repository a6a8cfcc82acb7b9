"""usagelake: usage analytics for AI coding assistants as Spark DataFrame operators."""

from usagelake.contract import EventFilters, Settings, Tables
from usagelake.session import build_session

__all__ = ["EventFilters", "Settings", "Tables", "build_session"]
