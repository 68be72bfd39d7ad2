"""Answers of models that may fail, behind guards, in phases; figures of runs side by side."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import judge as J
from textloom.functions import metaruns as M
from textloom.functions import text as T
from textloom.operators import calls, flows
from textloom.plans import judge
from textloom.plans.book import Book
from textloom.plans.corpus import MESSAGES, messages, sql

book = Book()

# Guarded answers
REFUSAL = "Bitte sprich mit einem Menschen: 0800 111 0 111."
SAID = f"""{judge.CRISIS}, said AS (SELECT doc_id, concat_ws(' ', text, CASE doc_id % 7 {" ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(judge.CRISIS_END))} END) AS m FROM documents),
heard AS (SELECT doc_id, m, doc_id % 4 AS k, len({judge.ECHO.format('m')}) > 0 AS echoes, list_reduce([0] || h, lambda s, w: CASE WHEN s >= LIMIT THEN s ELSE s + w END) >= LIMIT AS alarm FROM said JOIN hits USING (doc_id)),
routed AS (SELECT doc_id, m, CASE WHEN alarm THEN 'crisis in message' WHEN k = 2 THEN 'crisis in answer' WHEN k = 1 OR NOT echoes THEN 'answer' WHEN k = 0 THEN 'second answer' WHEN doc_id % 8 = 3 THEN 'still an echo' ELSE 'crisis in second answer' END AS route FROM heard)"""
ROUTED = f"""SELECT doc_id, route, CASE WHEN route = 'crisis in message' THEN 0 WHEN route IN ('second answer', 'still an echo', 'crisis in second answer') THEN 2 ELSE 1 END::INT AS calls,
md5(CASE WHEN starts_with(route, 'crisis') THEN '{REFUSAL}' WHEN route = 'second answer' THEN 'Danke dafür.' WHEN route = 'answer' AND doc_id % 4 = 1 THEN 'Erzähl mir mehr davon.' ELSE m END) AS answer_md5 FROM routed"""


def guarded(t, mode: Column) -> DataFrame:
    """Whole texts as messages; the stand-in answers with an echo, its own words or words of crisis."""
    k = F.col("doc_id") % 4
    first = lambda message: F.when(k == 1, "Erzähl mir mehr davon.").when(k == 2, "Ich will nicht mehr leben.").otherwise(message)
    second = lambda message: F.when(k == 0, "Danke dafür.").when(F.col("doc_id") % 8 == 3, message).otherwise("Ich will nicht mehr leben.")
    out = flows.guarded(judge.crisis_text(t), "x_answer", F.col("x"), mode, first, second, REFUSAL)
    return out.select("doc_id", "x_answer.route", "x_answer.calls", F.md5("x_answer.answer").alias("answer_md5"))


@book.query("R47_guarded_answer", sql(SAID.replace("LIMIT", "threshold"), ROUTED))
def guarded_answer(t):
    return guarded(t, F.col("mode"))


@book.query("R51_guarded_anchor", sql(SAID.replace("LIMIT", "2"), ROUTED))
def guarded_anchor(t):
    """The fourth mode, whose limit is low."""
    return guarded(t, F.lit("namaste"))


@book.query("O06_echo_guard", sql(f"{MESSAGES}, p AS (SELECT id, role, content, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said FROM messages), e AS (SELECT id, {judge.ECHO.format('content')} AS mine, {judge.ECHO.format('said')} AS theirs FROM p WHERE role = 'model' AND said IS NOT NULL)", "SELECT id, round(CASE WHEN len(mine) = 0 THEN 0 ELSE len(list_intersect(mine, theirs)) / len(mine)::DOUBLE END, 6)::DOUBLE AS overlap, CASE WHEN len(mine) > 0 AND len(list_intersect(mine, theirs)) / len(mine)::DOUBLE >= 0.6 THEN 2 ELSE 1 END::INT AS calls FROM e"))
def echo_guard(t):
    """Each answer against the last user turn before it, and how many calls that makes."""
    turns = flows.last_said(messages(t)).filter("role = 'model' and said is not null")
    overlap = J.echo_overlap(F.col("said"), F.col("content"))
    return turns.select("id", F.round(overlap, 6).alias("overlap"), F.when(overlap >= 0.6, 2).otherwise(1).alias("calls"))


# Calls that fail
def kind(prompt: str) -> int:
    return int(hashlib.md5(prompt.encode()).hexdigest()[:2], 16) % 8


def failing_model(prompts: list[str], k: int) -> list[str | Exception | None]:
    """Fails by the hash of the prompt: always, once, with empty answers twice or always."""
    out: list[str | Exception | None] = []
    for p in prompts:
        v = kind(p)
        out.append(RuntimeError("quota") if v == 0 or v == 1 and k == 0 else "  " if v == 2 and k < 2 else None if v == 3 else f"{len(p)}:{hashlib.md5(p.encode()).hexdigest()}")
    return out


KIND = "SELECT doc_id, text, ('0x' || md5(text)[1:2])::INT % 8 AS v FROM documents WHERE text IS NOT NULL"


@book.query("R67_llm_call", f"SELECT doc_id, CASE WHEN v IN (0, 3) THEN '' ELSE length(text) || ':' || md5(text) END AS answer, CASE v WHEN 0 THEN 'RuntimeError: quota' WHEN 3 THEN 'empty' END AS error FROM ({KIND})")
def llm_call(t):
    """Whole texts as prompts; an answer, or nothing and what went wrong."""
    asked = calls.call(t.documents.filter("text is not null").select("doc_id", "text"), F.col("text"), failing_model, sleep=calls.no_wait)
    return asked.select("doc_id", "call.answer", "call.error")


@book.query("R73_back_off", f"SELECT doc_id, CASE v WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 1 END::INT AS tries, CASE v WHEN 0 THEN 14.0 WHEN 1 THEN 2.0 WHEN 2 THEN 4.5 WHEN 3 THEN 10.5 ELSE 0.0 END::DOUBLE AS waited FROM ({KIND})")
def back_off(t):
    """How often each prompt was tried, and the waits, which double: longer after errors than after empty answers."""
    asked = calls.call(t.documents.filter("text is not null").select("doc_id", "text"), F.col("text"), failing_model, sleep=calls.no_wait)
    return asked.select("doc_id", "call.tries", "call.waited")


def json_model(prompts: list[str], k: int) -> list[str | Exception | None]:
    """JSON that breaks off always or once, prose, an error, or JSON in a fence."""
    out: list[str | Exception | None] = []
    for p in prompts:
        v, whole = kind(p), json.dumps({"n": len(p), "h": hashlib.md5(p.encode()).hexdigest()})
        out.append(whole[:-24] if v == 0 or v == 1 and k == 0 else "nichts" if v == 2 else RuntimeError("quota") if v == 3 else f"Hier:\n```json\n{whole}\n```")
    return out


JSON = "SELECT doc_id, CASE WHEN v NOT IN ({none}) THEN length(text) END AS n, CASE WHEN v = 0 AND 0 NOT IN ({none}) THEN md5(text)[1:10] WHEN v NOT IN ({none}) THEN md5(text) END AS h, CASE v WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 1 END::INT AS tries, CASE WHEN v NOT IN ({none}) THEN NULL WHEN v = 0 THEN 'cut off' WHEN v = 2 THEN 'no JSON' ELSE 'RuntimeError: quota' END AS error FROM ({kind})"


def llm_value(t, repair: bool) -> DataFrame:
    rows = t.documents.filter("text is not null").select("doc_id", "text")
    asked = calls.call_json(rows, F.col("text"), json_model, "n long, h string", sleep=calls.no_wait, repair=repair)
    return asked.select("doc_id", "value.value.n", "value.value.h", "value.tries", "value.error")


@book.query("R68_llm_json", JSON.format(none="0, 2, 3", kind=KIND))
def llm_json(t):
    """JSON answers; one that breaks off is asked for again, three times at most."""
    return llm_value(t, False)


@book.query("R69_llm_structured", JSON.format(none="2, 3", kind=KIND))
def llm_structured(t):
    """As ``llm_json``, but what still breaks off is closed and read by the schema."""
    return llm_value(t, True)


# Drafts in phases
def phased(t) -> DataFrame:
    """Drafts of three sections out of whole texts: whole, broken off after one, without any, or with bad references."""
    body = F.translate(T.squeeze(F.col("text")), "#[]<>", "     ")
    i = F.col("doc_id") % 4
    section = lambda n: F.concat(F.lit(f"### QUELLE [{n}]: Titel\n"), body, F.lit(f" [{n}]."))
    whole = F.concat_ws("\n\n", section(1), section(2), section(3))
    draft = F.when(i == 0, whole).when(i == 1, F.concat(section(1), F.lit("\n\nUnd dann bricht"))).when(i == 2, F.lit("Ohne Abschnitt.")).otherwise(F.concat(whole, F.lit("\n\nSchluss [7] und [9].")))
    return t.documents.filter("length(text) > 0").select("doc_id", draft.alias("draft"))


def next_section(kept: Column) -> Column:
    """The stand-in writes the first section that is missing."""
    n = F.try_element_at(J.missing_sections(kept, F.lit(3)), F.lit(1)).cast("string")
    return F.concat(F.lit("### QUELLE ["), n, F.lit("]: Titel\nNachtrag ["), n, F.lit("]."))


def wrong_references(draft: Column) -> Column:
    return F.filter(J.cited(F.regexp_replace(draft, r"###\s+QUELLE\s+\[[0-9]+\]", "")), lambda n: ~n.between(1, 3))


@book.query("N09_three_phases", "SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 0 END::INT AS continued, CASE doc_id % 4 WHEN 3 THEN 1 ELSE 0 END::INT AS corrected, FALSE AS refused, CASE doc_id % 4 WHEN 2 THEN 2 ELSE 3 END::INT AS sections FROM documents WHERE length(text) > 0")
def three_phases(t):
    """Drafts go on until all sections are there, two rounds at most, then bad references are taken out."""
    done = flows.phases(phased(t), "draft", F.lit(3), next_section, lambda draft, _: J.only_valid_references(draft, [1, 2, 3]), wrong_references)
    return done.select("doc_id", "continued", "corrected", "refused", (3 - F.size(J.missing_sections(F.col("draft"), F.lit(3)))).alias("sections"))


# Runs side by side
RUNS = ["R0", "R1", "R2", "R3"]


@book.query(
    "R39_agency_per_run",
    "WITH a AS (SELECT source AS author, 'R' || doc_id % 4 AS run, doc_id, CASE lang WHEN 'de' THEN 'aktiv' WHEN 'en' THEN 'passiv' END AS agency FROM documents WHERE source IS NOT NULL), f AS (SELECT author, run, arg_min(agency, doc_id) FILTER (agency IS NOT NULL) AS agency FROM a GROUP BY ALL) "
    + "SELECT author, " + ", ".join(f"coalesce(max(agency) FILTER (run = '{r}'), 'null') AS {r}" for r in RUNS) + " FROM f GROUP BY author",
)
def agency_per_run(t):
    """The agency of each author in each run, read from the run's answer; ``null`` where a run says nothing."""
    said = F.when(F.col("lang") == "de", '"aktiv"').when(F.col("lang") == "en", '"passiv"}').when(F.col("lang") == "fr", "null}").otherwise('"sonst"}')
    answer = F.concat(F.lit('Hier: {"'), "source", F.lit('": '), said)
    told = t.documents.filter("source is not null").select("doc_id", F.concat(F.lit("R"), (F.col("doc_id") % 4).cast("string")).alias("run"), F.explode(M.json_map(answer, ("aktiv", "passiv"))).alias("author", "agency"))
    every = t.documents.select(F.col("source").alias("author")).filter("author is not null").distinct()
    table = told.groupBy("author").pivot("run", RUNS).agg(F.min_by("agency", F.when(F.col("agency").isNotNull(), F.col("doc_id"))))
    return every.join(table, "author", "left").fillna("null", RUNS)
