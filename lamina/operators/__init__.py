"""Relational operators: functions from DataFrame to DataFrame, to be chained with ``DataFrame.transform``."""

from lamina.operators.relational import aggregate, first_seen, group_by, order, page, project, scan, top_k, where

__all__ = ["aggregate", "first_seen", "group_by", "order", "page", "project", "scan", "top_k", "where"]
