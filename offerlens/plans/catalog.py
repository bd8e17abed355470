"""All registered queries."""

from offerlens.plans import card_queries, offer_queries, service_queries, stream_queries, text_queries, time_queries  # noqa: F401
from offerlens.plans.registry import ORACLES, QUERIES  # noqa: F401
