"""Composed plans, the query catalogue and its SQL."""

from . import assembly_queries, edge_queries, itinerary_queries, journey_queries, places_queries, realtime_queries, schedule_queries, station_queries

_MODULES = (schedule_queries, realtime_queries, places_queries, journey_queries, station_queries, itinerary_queries, assembly_queries, edge_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: text for module in _MODULES for name, text in module.ORACLES.items()}
