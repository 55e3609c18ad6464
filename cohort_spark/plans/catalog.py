"""Registry of named queries (inventory ids) and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle_views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(qid: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[QueryFn], QueryFn]:
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``qid``; ``sql`` is the
    oracle (omitted for operators an SQL engine cannot express)."""

    def deco(fn: QueryFn) -> QueryFn:
        if qid in QUERIES:
            raise ValueError(f"duplicate query id {qid}")
        QUERIES[qid] = fn
        if sql is not None:
            ORACLE[qid] = with_views(sql, *views) if views else sql
        return fn

    return deco


def load_all() -> None:
    """Import every query module so their ``register`` calls run."""
    from . import (  # noqa: F401
        q_cohort, q_clinical, q_match, q_sampling, q_masks, q_boxes, q_moves, q_radiomics, q_eval, q_trainlog,
    )
