"""All registered queries, by importing the modules that declare them."""

from __future__ import annotations

from . import queries_cluster, queries_logit, queries_quality, queries_recode, queries_sem, queries_tables  # noqa: F401
from .registry import CHECKS, QUERIES


def queries():
    return dict(QUERIES)


def checks():
    return dict(CHECKS)
