"""All registered questions."""

from workload import questions_ingest, questions_log, questions_usage  # noqa: F401
from workload.registry import QUERIES, SQL  # noqa: F401
