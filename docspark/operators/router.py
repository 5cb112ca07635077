"""Routing of questions: small talk, overrides of a planner's choice, and which file a report is about."""

from __future__ import annotations

from difflib import get_close_matches

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import SMALL_TALK


def small_talk(question: Column) -> Column:
    """Category of a message that needs no retrieval, or null; a lookup in a literal map, no join."""
    table = F.create_map(*[F.lit(x) for kind, phrases in SMALL_TALK.items() for p in phrases for x in (p, kind)])
    form = T.small_talk_form(question)
    return F.when(form != "", F.element_at(table, form))


def routed(action: Column, n_documents: Column, n_retrieved: Column, chatty: Column) -> Column:
    """The action that is taken: evidence is never discarded, and nothing but small talk is answered without looking."""
    return (
        F.when((action == "respond") & (n_documents > 0), "generate")
        .when(action.isin("respond", "generate") & (n_documents == 0) & (n_retrieved == 0) & ~chatty, "retrieve")
        .otherwise(action)
    )


def resolve_report_target(files: list[str], requested: str | None, active: str | None) -> tuple[str | None, list[str] | None]:
    """(file, None), or (None, candidates) to choose from, or (None, None) if a named file is not there."""
    if requested:
        low = requested.strip().lower()
        for test in (lambda f: f.lower() == low, lambda f: low in f.lower() or f.lower().rsplit(".", 1)[0] in low):
            if found := next((f for f in files if test(f)), None):
                return found, None
        close = get_close_matches(requested, files, n=1, cutoff=0.6)
        return (close[0], None) if close else (None, None)
    if active in files:
        return active, None
    return (files[0], None) if len(files) == 1 else (None, files)
