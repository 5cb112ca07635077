"""A turn of a conversation: a planner chooses tools until one ends the turn; rules correct it where it would drop or skip evidence."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking, router
from ..plugins import Planner, Rejected
from .api import Engine

#: What a planner may choose, the arguments each tool takes with their kinds, and the tools that end a turn.
TOOLS = {
    "retrieve": {"question": str, "top_k": int}, "generate": {"question": str}, "summarize": {}, "compare": {"question": str},
    "respond": {"question": str}, "report": {"document": str, "topic": str},
}
ENDING = ("generate", "summarize", "compare", "respond", "report")
MOST_STEPS, RETRIES, QUESTION_CHARS, TOP_K = 6, 2, 500, 5
CANNED = {
    "en": {"greeting": "Hello! Ask me about your documents.", "thanks": "You are welcome.", "farewell": "Goodbye.", "ack": "All right.", "identity": "I answer questions about uploaded documents."},
    "ar": {"greeting": "أهلا! اسألني عن مستنداتك.", "thanks": "على الرحب والسعة.", "farewell": "مع السلامة.", "ack": "حسنا.", "identity": "أجيب عن أسئلة حول المستندات المرفوعة."},
}


@dataclass
class Turn:
    """What a turn knows and has done."""

    question: str
    conversation_id: str
    lang: str
    memory: str = ""
    found: list[DataFrame] = field(default_factory=list)
    seen: list[str] = field(default_factory=list)
    retrieved: list[str] = field(default_factory=list)
    observations: list[dict] = field(default_factory=list)
    answer: str = ""
    sources: str = ""
    report: str | None = None
    active: str | None = None

    def documents(self) -> DataFrame | None:
        """All chunks found, the first search's first, ranked anew."""
        if not self.found:
            return None
        rows = None
        for i, part in enumerate(self.found):
            part = part.withColumn("search", F.lit(i)).withColumn("question", F.lit(self.question))
            rows = part if rows is None else rows.unionByName(part)
        place = F.row_number().over(ranking.Window.partitionBy("question").orderBy("search", "rank"))
        return rows.withColumn("place", place).drop("rank", "search").withColumnRenamed("place", "rank")


def checked(raw: str) -> tuple[str, dict]:
    """(tool, arguments) of a planner's JSON text; ValueError if it is no such thing."""
    said = json.loads(raw)
    if not isinstance(said, dict) or said.get("action") not in TOOLS:
        raise ValueError("no known action")
    given, allowed = said.get("arguments") or {}, TOOLS[said["action"]]
    if not isinstance(given, dict):
        raise ValueError("arguments are no object")
    out = {}
    for name, kind in allowed.items():
        value = given.get(name)
        if value is None:
            if name == "question":
                raise ValueError("a question is missing")
            continue
        if not isinstance(value, kind):
            raise ValueError(f"{name} is no {kind.__name__}")
        out[name] = value
    return said["action"], out


def planned(planner: Planner, messages: list[dict], question: str, fallback: Planner | None = None, retries: int = RETRIES) -> tuple[str, dict]:
    """A valid action: malformed ones are asked for again, a refused request goes once to the fallback; at last, retrieval. Other errors rise."""
    messages, used = list(messages), planner
    for _ in range(retries + 1):
        try:
            return checked(used.plan(messages))
        except Rejected:
            used = fallback or used
        except ValueError:
            messages = [*messages, {"role": "user", "content": "That was no valid action. Return one JSON object of the shape described."}]
    return "retrieve", {"question": question[:QUESTION_CHARS], "top_k": TOP_K}


class Agent:
    """Runs turns over an engine. ``fallback`` plans where the planner's provider refuses."""

    def __init__(self, engine: Engine, planner: Planner | None = None, fallback: Planner | None = None):
        self.engine, self.planner, self.fallback = engine, planner or engine.planner, fallback
        self.active: dict[str, str] = {}

    def _messages(self, turn: Turn) -> list[dict]:
        state = {"question": turn.question, "active_document": turn.active, "memory": turn.memory, "documents": len(turn.seen), "retrieved": turn.retrieved, "observations": turn.observations}
        return [{"role": "system", "content": json.dumps({k: {a: t.__name__ for a, t in v.items()} for k, v in TOOLS.items()})}, {"role": "user", "content": json.dumps(state, ensure_ascii=False)}]

    def _category(self, question: str) -> str | None:
        return self.engine.spark.range(1).select(router.small_talk(F.lit(question))).first()[0]

    def _corrected(self, turn: Turn, action: str, arguments: dict, chatty: bool) -> tuple[str, dict]:
        taken = self.engine.spark.range(1).select(router.routed(F.lit(action), F.lit(len(turn.seen)), F.lit(len(turn.retrieved)), F.lit(chatty))).first()[0]
        return (action, arguments) if taken == action else (taken, {"question": turn.question[:QUESTION_CHARS]} | ({"top_k": TOP_K} if taken == "retrieve" else {}))

    def _retrieve(self, turn: Turn, question: str, top_k: int = TOP_K) -> None:
        if question.strip().lower() in (q.strip().lower() for q in turn.retrieved):
            turn.observations.append({"tool": "retrieve", "question": question, "status": "already_retrieved"})
            return
        raw = turn.question if not turn.retrieved else None  # the user's own words go with the first search only
        found = self.engine.search(question, turn.conversation_id, top_k, raw_question=raw, seen=turn.seen)
        ids = [r["point_id"] for r in found.select("point_id").collect()]  # top_k rows
        turn.retrieved.append(question)
        turn.observations.append({"tool": "retrieve", "question": question, "found": len(ids)})
        if ids:
            turn.found.append(found)
            turn.seen += ids
            top = ranking.active_source(turn.documents(), "question", "rank", "source").first()
            turn.active = self.active[turn.conversation_id] = top["source"]

    def _end(self, turn: Turn, action: str, arguments: dict) -> Iterator[str]:
        """The answer's pieces as the ending tool makes them."""
        docs, e = turn.documents(), self.engine
        if action == "report":
            files_ = [r["filename"] for r in e.list_files(turn.conversation_id).collect()]  # a conversation's files
            topic = arguments.get("topic")
            target, candidates = router.resolve_report_target(files_, arguments.get("document"), turn.active)
            if topic:
                made = e.topic_report_data(topic, turn.conversation_id, target if arguments.get("document") else None)
            elif target:
                made = e.report_data(turn.conversation_id, target)
            else:
                yield "Which document? " + ", ".join(candidates) if candidates else "There is no such document."
                return
            turn.report = e.write_report(made, topic)
            yield f"The report is ready: {turn.report}"
        elif action == "respond" or docs is None and action != "generate":
            yield from e.answer_from_memory_stream(turn.question, turn.memory, turn.lang)
        elif action == "summarize":
            yield from e.summarize_stream(docs, turn.lang)
        elif action == "compare":
            yield from e.compare_stream(arguments["question"], docs, turn.lang)
        else:
            empty = e.spark.createDataFrame([], "question string, rank int, text string, source string, page int, file_type string, sheet_name string, chunk_type string, row_range string")
            yield from e.generate_stream(arguments.get("question", turn.question), docs if docs is not None else empty, turn.lang, turn.memory)

    def stream(self, question: str, conversation_id: str, memory_text: str = "", language: str = "auto") -> Iterator[dict]:
        """Events of a turn: start, status per step, token per piece, then done with the answer, or error."""
        yield {"type": "start", "conversation_id": conversation_id}
        try:
            lang = self.engine.language(question) if language == "auto" else language
            turn = Turn(question, conversation_id, lang, memory_text, active=self.active.get(conversation_id))
            category = self._category(question)
            if category in CANNED[lang]:
                turn.answer = CANNED[lang][category]
                yield {"type": "token", "text": turn.answer}
            else:
                action, arguments = "generate", {"question": question}
                for _ in range(MOST_STEPS):
                    action, arguments = self._corrected(turn, *planned(self.planner, self._messages(turn), question, self.fallback), category is not None)
                    yield {"type": "status", "action": action}
                    if action in ENDING:
                        break
                    self._retrieve(turn, arguments["question"], arguments.get("top_k", TOP_K))
                    action, arguments = "generate", {"question": question}  # where the steps run out
                pieces = []
                for piece in self._end(turn, action, arguments):
                    pieces.append(piece)
                    yield {"type": "token", "text": piece}
                turn.answer = "".join(pieces).strip()
                docs = turn.documents()
                turn.sources = self.engine.sources(docs, turn.answer) if docs is not None and action != "report" else ""
            yield {"type": "done", "answer": turn.answer, "sources": turn.sources, "report": turn.report, "retrieved": turn.retrieved}
        except Exception as e:
            yield {"type": "error", "message": str(e)[:500]}

    def run(self, question: str, conversation_id: str, memory_text: str = "", language: str = "auto") -> dict:
        """The last event of a turn; an error rises."""
        last = {}
        for last in self.stream(question, conversation_id, memory_text, language):
            pass
        if last["type"] == "error":
            raise RuntimeError(last["message"])
        if last["answer"] and last["retrieved"]:
            last["answer"] = self.engine._clean(last["answer"], self.engine.language(question) if language == "auto" else language)
        return last


def first_of_turn(searches: DataFrame, turn: str, question: str, order: str) -> DataFrame:
    """Searches of many turns without those that repeat an earlier question of their turn, whatever its case and margins; null is no blank question."""
    form = F.lower(T.strip(F.col(question)))
    return searches.withColumn("_n", F.row_number().over(ranking.Window.partitionBy(turn, form).orderBy(order))).where("_n = 1").drop("_n")


def token_totals(calls: DataFrame, turn: str) -> DataFrame:
    """``turn`` and the sums of prompt, completion and total tokens of its calls, null as 0."""
    return calls.groupBy(turn).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")])
