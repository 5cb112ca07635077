"""Prompts for a text generator, as columns: what to do, the material between marks that make it data, then the question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T


def _by(lang: Column, ar: str, en: str) -> Column:
    return F.when(lang == "ar", ar).otherwise(en)


def _lines(*parts: Column) -> Column:
    """Parts that are there, parted by blank lines."""
    return F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts])


def _asked(question: Column, lang: Column) -> Column:
    return F.concat(_by(lang, "السؤال: ", "Question: "), F.coalesce(question, F.lit("")))


def answer(question: Column, context: Column, lang: Column, memory: Column) -> Column:
    """Answer from the context alone, or say that it is not there."""
    task = _by(lang, "أجب من محتوى المستندات أدناه فقط. إذا لم يتضمن الإجابة فقل إنها غير موجودة في الملفات المرفوعة.", "Answer from the document content below and nothing else. If it does not hold the answer, say that the information is not available in the uploaded files.")
    return _lines(task, F.coalesce(memory, F.lit("")), T.wrap_untrusted(context, lang), _asked(question, lang))


def from_memory(question: Column, memory: Column, lang: Column) -> Column:
    task = _by(lang, "أجب من سجل المحادثة أدناه فقط.", "Answer from the conversation so far, shown below, and nothing else.")
    return _lines(task, F.coalesce(memory, F.lit("")), _asked(question, lang))


def summary(context: Column, lang: Column) -> Column:
    return _lines(_by(lang, "لخص محتوى المستندات أدناه.", "Summarise the document content below."), T.wrap_untrusted(context, lang))


def comparison(question: Column, context: Column, lang: Column) -> Column:
    return _lines(_by(lang, "قارن بين ما في محتوى المستندات أدناه بحسب السؤال.", "Compare what the document content below says, as the question asks."), T.wrap_untrusted(context, lang), _asked(question, lang))


def extraction(body: Column, part: Column, parts: Column, lang: Column) -> Column:
    """One slice of a report: a JSON object with the fields of an extract."""
    place = F.concat(_by(lang, "الجزء ", "Part "), part.cast("string"), F.lit("/"), parts.cast("string"))
    fields = "section_title, summary, key_points, definitions (term, definition), technical_terms, numbers, equations, best_practices, figures_tables"
    task = F.concat(_by(lang, "استخرج كائن JSON واحدا بهذه الحقول: ", "Extract one JSON object with these fields: "), F.lit(fields))
    return _lines(task, place, T.wrap_untrusted(body, lang))


def narratives(digest: Column, points: Column, label: Column, lang: Column) -> Column:
    """All narrative parts of a report in one request: a JSON object with four keys."""
    task = F.concat(_by(lang, "اكتب كائن JSON واحدا لتقرير عن ", "Write one JSON object for a report on "), label, F.lit(": executive_summary, introduction, relationships, conclusion."))
    return _lines(task, points, T.wrap_untrusted(digest, lang))


def topic_gate(topic: Column, sample: Column, lang: Column) -> Column:
    ask = F.concat(_by(lang, "هل في المقتطفات أدناه ما يخص هذا الموضوع؟ أجب بنعم أو لا: ", "Do the excerpts below say anything on this topic? Answer yes or no: "), topic)
    return _lines(ask, T.wrap_untrusted(sample, lang))


def memory_text(facts: Column, messages: Column) -> Column:
    """What is known of a conversation: its facts, then its last messages; blocks that are empty are left out."""
    block = lambda title, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(title), body))
    return F.concat_ws("\n\n", block("Known facts:\n", facts), block("Recent messages:\n", messages))
