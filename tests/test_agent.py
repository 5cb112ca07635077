"""Turns of an agent, answers, reports and memory over a small store; models are scripted."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from docspark.config import Settings
from docspark.functions import tokens
from docspark.operators import memory, objects
from docspark.plans import agent, catalog, extended_sql, sql  # noqa: F401  (the extended ones add to the others)
from docspark.plans.api import Engine, new_session
from docspark.plugins import Prefixed, Rejected, Remembering, RulePlanner, embedding, reranked
from docspark.sources import files


class Scripted:
    """A planner that says one thing after the other."""

    def __init__(self, *said):
        self.said, self.heard = list(said), []

    def plan(self, messages):
        self.heard.append(messages)
        x = self.said.pop(0)
        if isinstance(x, Exception):
            raise x
        return x if isinstance(x, str) else json.dumps(x)


def act(action, **arguments):
    return {"action": action, "arguments": arguments}


class Echo:
    provider = "echo"

    def __init__(self):
        self.prompts = []

    def invoke(self, prompt):
        self.prompts.append(prompt)
        return "line one\nline one\nline two"

    def stream(self, prompt):
        self.prompts.append(prompt)
        yield from ("line one\n", "line two")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("agent")
    (folder / "in").mkdir()
    (folder / "in" / "tea.txt").write_text("The zanzibar harbour opens at nine. Ships bring cloves and tea every day of the week. Zanzibar is an island of spices.")
    (folder / "in" / "maths.md").write_text("Integral calculus studies accumulation. A derivative measures change of a quantity. Calculus is a branch of mathematics.")
    (folder / "in" / "stock.csv").write_text("good,price\n" + "\n".join(f"cloves of sort {i},{i}.5" for i in range(60)))
    e = Engine(spark, str(folder / "store"))
    assert e.ingest(str(folder / "in"), "c1") > 4
    assert e.ingest(str(folder / "in"), "c2", "*.[tm]*") >= 2  # without the sheet
    return e


def test_search_widens_for_sheets_and_filters_by_source(engine):
    rows = engine.search("price of cloves of sort 7", "c1").collect()
    assert len(rows) > engine.settings.top_n - 1 and any(r["file_type"] == "excel" and r["row_range"] for r in rows)
    assert {r["source"] for r in engine.search("zanzibar harbour", "c1", source="tea.txt").collect()} == {"tea.txt"}
    assert engine.search("zanzibar harbour", "other").count() == 0
    seen = [r["point_id"] for r in rows]
    assert not set(seen) & {r["point_id"] for r in engine.search("price of cloves of sort 7", "c1", seen=seen).collect()}
    labels = engine.context(engine.search("price of cloves of sort 7", "c1")).first()["context"]
    assert "Sheet: stock" in labels


def test_many_questions_in_one_plan(engine, spark):
    """As asked one by one, each of its own conversation; no conversation, no rows."""
    asked = [("q1", "c1", "when does the zanzibar harbour open"), ("q2", "c2", "zanzibar spices"), ("q3", "c1", "cloves of sort 7"), ("q4", "c2", "what is a derivative"), ("q5", "nowhere", "zanzibar")]
    got = engine.search_many(spark.createDataFrame(asked, "question_id string, conversation_id string, question string")).collect()
    for name, conversation, question in asked[:4]:
        want = [(r["rank"], r["point_id"], round(r["score"], 9)) for r in engine.search(question, conversation).orderBy("rank").collect()]
        assert want and sorted((r["rank"], r["point_id"], round(r["score"], 9)) for r in got if r["question_id"] == name) == want
    assert {r["question_id"] for r in got} == {"q1", "q2", "q3", "q4"}
    only = spark.createDataFrame([(*asked[0], "maths.md"), (*asked[3], None)], "question_id string, conversation_id string, question string, file string")
    files_ = {(r["question_id"], r["source"]) for r in engine.search_many(only, "file").collect()}
    assert {f for q, f in files_ if q == "q1"} <= {"maths.md"} and len({f for q, f in files_ if q == "q4"}) == 2


def test_planner_text_is_checked():
    assert agent.checked(json.dumps(act("retrieve", question="q"))) == ("retrieve", {"question": "q"})
    for bad in ("no json", "[]", json.dumps(act("fly")), json.dumps(act("retrieve")), json.dumps(act("retrieve", question=3)), json.dumps({"action": "generate", "arguments": []})):
        with pytest.raises(ValueError):
            agent.checked(bad)


def test_planner_is_asked_again_then_retrieval():
    p = Scripted("x", "y", act("generate", question="q"))
    assert agent.planned(p, [{"role": "user", "content": "{}"}], "q") == ("generate", {"question": "q"}) and len(p.heard[-1]) == 3
    assert agent.planned(Scripted("x", "y", "z"), [], "q" * 900) == ("retrieve", {"question": "q" * 500, "top_k": 5})
    assert agent.planned(Scripted(Rejected()), [], "q", Scripted(act("summarize"))) == ("summarize", {})
    with pytest.raises(KeyError):
        agent.planned(Scripted(KeyError()), [], "q")


def test_turn_retrieves_then_answers(engine):
    events = list(agent.Agent(engine).stream("when does the zanzibar harbour open", "c2"))
    assert [e["type"] for e in events if e["type"] != "token"] == ["start", "status", "status", "done"]
    assert "nine" in events[-1]["answer"] and events[-1]["sources"].startswith("Sources: tea.txt")
    assert "".join(e["text"] for e in events if e["type"] == "token").strip() == events[-1]["answer"]


def test_turn_is_corrected(engine):
    a = agent.Agent(engine, Scripted(act("respond", question="q"), act("respond", question="q")))
    statuses = [e["action"] for e in a.stream("zanzibar harbour", "c2") if e["type"] == "status"]
    assert statuses == ["retrieve", "generate"]  # never answered without looking, and evidence is not dropped
    assert a.active["c2"] == "tea.txt"


def test_turn_skips_repeats_and_ends_after_six_steps(engine):
    p = Scripted(*[act("retrieve", question="Zanzibar " if i % 2 else "zanzibar") for i in range(6)])
    done = agent.Agent(engine, p).run("zanzibar", "c1")
    assert done["retrieved"] == ["zanzibar"] and done["answer"]
    assert "already_retrieved" in p.heard[-1][-1]["content"]


def test_small_talk_and_errors(engine):
    assert agent.Agent(engine, Scripted()).run("hello!", "c1")["answer"].startswith("Hello")
    assert agent.Agent(engine, Scripted()).run("مرحبا", "c1")["answer"].startswith("أهلا")
    events = list(agent.Agent(engine, Scripted(OSError("down"))).stream("zanzibar harbour", "c1"))
    assert events[-1] == {"type": "error", "message": "down"}
    with pytest.raises(RuntimeError):
        agent.Agent(engine, Scripted(OSError("down"))).run("zanzibar harbour", "c1")


@pytest.mark.parametrize("action", ["summarize", "compare", "generate", "respond"])
def test_tools_ask_the_generator(engine, action):
    echo = Echo()
    engine.generator, before = echo, engine.generator
    try:
        arguments = {} if action == "summarize" else {"question": "zanzibar"}
        p = Scripted(act("retrieve", question="zanzibar harbour"), act(action, **arguments))
        done = agent.Agent(engine, p).run("zanzibar harbour", "c1", memory_text="Known facts:\n- tea")
    finally:
        engine.generator = before
    assert done["answer"] == "line one\nline two"
    assert "zanzibar" in echo.prompts[0] and ("[document content" in echo.prompts[0])


def test_answers_without_a_model(engine):
    found = engine.search("zanzibar harbour", "c1").persist()
    none = found.limit(0)
    assert engine.generate("q", none, "en").startswith("No relevant") and list(engine.generate_stream("q", none, "ar"))[0].startswith("لا توجد")
    assert engine.summarize(found, "en") and engine.compare("harbour", found, "en")
    assert "".join(engine.summarize_stream(found, "en")).strip() == engine.summarize(found, "en")
    assert "".join(engine.compare_stream("harbour", found, "en")).strip() == engine.compare("harbour", found, "en")
    assert "tea" in engine.answer_from_memory("tea", "Known facts:\n- likes tea", "en")
    assert "".join(engine.answer_from_memory_stream("tea", "Known facts:\n- likes tea", "en")).strip()
    assert engine.sources(found, "The information is not available in the uploaded files.") == ""


def test_reports(engine):
    made = engine.report_data("c1", "tea.txt")
    titles = [r["title"] for r in made["rendered"].orderBy("place").collect()]
    assert titles[0] == "executive_summary" and titles[-1] == "conclusion"
    assert made["definitions"].count() == 1 and made["extent"].first()["page_count"] == 1
    path = engine.write_report(made)
    name = path.rsplit("/", 1)[-1]
    assert name == "tea.txt_report.pdf" and files.pdf_pages(engine.objects.get(name))[0] == "tea.txt"
    assert engine.objects.get(engine.write_report(made, markdown=True).rsplit("/", 1)[-1]).decode().startswith("# tea.txt")
    assert engine.report("c1", "tea.txt").count() > 0
    topic = engine.topic_report_data("zanzibar harbour", "c1")
    assert "tea.txt" in topic["extent"].first()["sources"]
    with pytest.raises(ValueError):
        engine.topic_report_data("qqq www", "c1")
    with pytest.raises(ValueError):
        engine.report_data("c1", "none.txt")
    done = agent.Agent(engine, Scripted(act("report", document="tea"))).run("report on tea please, all of it", "c1")
    assert done["report"].endswith("tea.txt_report.pdf")
    assert "Which document" in agent.Agent(engine, Scripted(act("report"))).run("a report please on something", "c1")["answer"]
    assert "zanzibar" in engine.full_text("c1", "tea.txt")


def test_reports_ask_the_generator(engine, spark):
    class Model(Echo):
        def invoke(self, prompt):
            self.prompts.append(prompt)
            return "no" if "yes or no" in prompt else "```json\n{\"introduction\": \"told\", \"conclusion\": \"ended\"}\n```"

    engine.generator, before = Model(), engine.generator
    try:
        row = engine.report_data("c1", "tea.txt")["narratives"].first()
        assert (row["introduction"], row["conclusion"], row["executive_summary"]) == ("told", "ended", "")
        with pytest.raises(ValueError):
            engine.topic_report_data("zanzibar harbour", "c1")
    finally:
        engine.generator = before


def test_memory_and_facts(engine, spark):
    engine.fact_files.save("c/1", [{"text": "likes tea", "category": "preference", "importance": 5, "updated_at": "2024-01-01"}])
    assert engine.fact_files.exists("c/1") and objects.safe_id("") == "default"
    said = spark.createDataFrame([("c/1", i, "user", f"message {i}") for i in range(9)], "conv_id string, turn int, role string, text string")
    text = engine.memory_text("c/1", said)
    assert text.startswith("Known facts:\n- [preference] likes tea") and text.endswith("User: message 8") and "message 2" not in text
    assert engine.memory_text("none", said) == ""
    assert engine.fact_files.delete("c/1") and not engine.fact_files.exists("c/1")
    facts = spark.createDataFrame([("a b", i, f"fact {i}", "fact", 3, None) for i in range(3)], "conversation_id string, pos int, text string, category string, importance int, updated_at timestamp")
    row = objects.fact_documents(facts).first()
    assert row["name"] == "a_b.json" and [f["text"] for f in json.loads(row["body"])["facts"]] == ["fact 0", "fact 1", "fact 2"]


def test_fact_files_of_both_versions(spark, tmp_path):
    (tmp_path / "old.json").write_text(json.dumps({"version": 1, "summary": "Likes tea.", "updated_at": "2024"}))
    (tmp_path / "new.json").write_text(json.dumps({"version": 2, "facts": [{"text": "a", "category": "task", "importance": 2}, {"text": " "}]}))
    (tmp_path / "bad.json").write_text("{")
    got = {(r["conversation_id"], r["text"], r["category"]) for r in files.fact_files(spark, str(tmp_path)).collect()}
    assert got == {("old", "Likes tea.", "fact"), ("new", "a", "task")}


def test_stages_views_and_uploads(engine, spark):
    engine.search("zanzibar", "c1")
    assert {r["stage"] for r in engine.profile().collect()} >= {"retrieval", "reranking"}
    assert engine.upload("../odd:name.txt", b"A note on pepper and cinnamon, long enough to be indexed.", "c9") == 1
    assert engine.objects.table("odd_name_*").count() == 1
    engine.register("t_")
    assert spark.sql("SELECT count(DISTINCT conversation_id) FROM t_chunks").first()[0] == 3
    assert spark.sql("SELECT size(recursive_chunks('a. b. c', 4, 0)), size(hash_embedding('a'))").first() == (2, 128)
    assert engine.store.ready() and engine.store.registered("c9").count() == 1
    with pytest.raises(RuntimeError):
        engine.store._check(spark.createDataFrame([([1.0],)], "embedding array<double>"))


def test_models_plug_in(engine, spark):
    encoder = Prefixed(lambda texts: [[float(len(t)), 1.0 if t.startswith("query: ") else 0.0] for t in texts], 2)
    df = spark.createDataFrame([("a",), ("bcd",)], "t string")
    rows = df.select(embedding(encoder, F.col("t")).alias("d"), embedding(encoder, F.col("t"), True).alias("q")).collect()
    assert all(abs(sum(x * x for x in r["d"]) - 1) < 1e-9 and r["d"][1] == 0 and r["q"][1] > 0 for r in rows)

    class Ranker:
        def score(self, query, texts):
            if query == "bad":
                raise ValueError
            return [float(len(t)) for t in texts]

    pairs = spark.createDataFrame([("q", "a"), ("q", "abc"), ("bad", "a")], "q string, t string").select("q", "t", reranked(Ranker(), F.col("q"), F.col("t")).alias("s"))
    got = {(r["q"], r["t"]): r["s"] for r in pairs.collect()}
    assert 0.5 < got["q", "a"] < got["q", "abc"] < 1 and got["bad", "a"] is None
    engine.reranker = Ranker()
    try:
        assert engine.search("zanzibar harbour", "c1").count() > 0
    finally:
        engine.reranker = None

    class Other:
        calls = 0

        def rewrite(self, question, lang):
            Other.calls += 1
            return {"alternatives": ["harbour of zanzibar", " "], "corrected": "zanzibar harbour", "translated": None}

    keep = Remembering(Other())
    assert keep.rewrite("q", "en") == keep.rewrite("q", "en") == (["harbour of zanzibar"], "zanzibar harbour", "") and Other.calls == 1
    assert Remembering(None).rewrite("q", "en") == ([], "", "")
    assert json.loads(RulePlanner().plan([{"content": "{}"}]))["action"] == "retrieve"


def test_tokens_and_shapes():
    assert tokens.is_signed("c", tokens.sign("c", "s"), "s") and not tokens.is_signed("c", "x", "s") and not tokens.is_signed("c", None, "s")
    assert tokens.shaped("abc 12") == "abc 12"
    assert tokens.shaped("سلام") == "\ufee1\ufefc\ufeb3"  # meem alone after lam-alef, final lam-alef, initial seen, from the right
    assert tokens.shaped("ab سلام cd") == "ab \ufee1\ufefc\ufeb3 cd"


def test_sessions_and_health(engine):
    made, token = new_session("s")
    assert tokens.is_signed(made, token, "s") and engine.health() == {"store": True, "objects": True}


def test_settings_from_the_environment(monkeypatch):
    monkeypatch.setenv("TOP_K", "11")
    monkeypatch.setenv("MMR_LAMBDA", "bad")
    assert Settings.from_env().top_k == 11 and Settings.from_env().mmr_lambda == 0.7


def test_repeated_questions_equal_their_sql(spark, tmp_path):
    """Whole texts are compared, in any case and with any margins; a null text took the place of a blank one."""
    said = ["What is it?", " what IS it? ", "What is it? More.", "\tWHAT IS IT?\n", "Éa b", "éA B", "éA  B"]
    rows = [(1, i, x) for i, x in enumerate(said)] + [(2, i, x) for i, x in enumerate([said[0], None, "", "  ", None])]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, catalog.QUERIES["repeated_questions"](spark, str(tmp_path)).collect()))
    want = duckdb.connect().execute(sql.ORACLES["repeated_questions"].replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'")).fetchall()
    assert got == sorted(want) == [(1, 0), (1, 2), (1, 4), (1, 6), (2, 0), (2, 1), (2, 2)]
