"""Registered queries over the given tables, each with its equivalent in plain SQL where SQL can say it."""

from __future__ import annotations

import importlib

_MODULES = ("text_queries", "quality_queries", "corpus_queries", "mixing_queries", "grading_queries", "source_queries")


def _load():
    from corpusmill.catalog import base

    for name in _MODULES:
        importlib.import_module(f"corpusmill.catalog.{name}")
    return base


def all_queries():
    return dict(_load().QUERIES)


def all_sql():
    return dict(_load().ORACLE)
