"""Importing this module registers every query."""

from tallyspark.plans import q_basket, q_changes, q_demand, q_markers, q_nutrition, q_places, q_prices, q_providers, q_replication, q_resolve, q_shopping, q_sources, q_streams, q_text, q_watch, q_workflow  # noqa: F401
