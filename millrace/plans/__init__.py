"""Fluent pipelines, control flow and the registered queries."""
