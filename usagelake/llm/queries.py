"""All queries of the subpackage; importing the modules registers them."""

from . import (  # noqa: F401
    decontaminate, exact_dedup, filter_audit, html_main, language, licenses, line_dedup, mixing, quality, secrets,
    sharding, simhash, token_alignment,
)
from .registry import QUERIES, SQL  # noqa: F401
