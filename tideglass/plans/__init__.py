"""Registered queries, by area. Importing this package fills the registry."""

from tideglass.plans import aggregates, audits, baselines, catalogue, dpd, episodes, joins, payments, policies, risk, signal_catalogue, sources, streams, temporal, tracing, utilization  # noqa: F401
