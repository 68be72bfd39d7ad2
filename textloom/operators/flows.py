"""Flows of several model calls: what goes into each call and what becomes of its answer.

A model is a function from the Column of a prompt to the Column of its answer; null stands for
a call that failed. The calls of a row run where the row lies; but for ``last_said`` no flow moves rows.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import judge as J
from textloom.functions import text as T
from textloom.session import settle

Model = Callable[[Column], Column]

#: All images of one call together.
IMAGE_BYTES = 20 * 1024 * 1024
QUOTES = "array<struct<source_id: int, speaker: string, quote: string>>"
FACTS = "array<struct<source_id: int, speaker: string, date: string, mode: string, fact: string, quote: string>>"


def points(answer: Column) -> Column:
    """The list in a critic's answer, each point as JSON; an object is a list of one, all else null."""
    json = J.json_of(answer)
    return F.from_json(F.when(F.startswith(json, F.lit("{")), F.concat(F.lit("["), json, F.lit("]"))).otherwise(json), "array<string>")


class Steps:
    """Columns put on a DataFrame one after the other, so that each is made once a row, and taken off at the end."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.own = df, []

    def put(self, column: Column) -> Column:
        name = f"__step_{uuid.uuid4().hex}"
        self.df = self.df.withColumn(name, column)
        self.own.append(name)
        return F.col(name)

    def call(self, model: Model, task: str, *sections: tuple[str, Column]) -> Column:
        return self.put(model(self.put(T.assembled(task, *sections))))

    def done(self, out: str, column: Column) -> DataFrame:
        return self.df.withColumn(out, column).drop(*self.own)


def revised(df: DataFrame, out: str, draft: Column, language: Column, critic: Model, editor: Model, task: str, keep: int = 3) -> DataFrame:
    """A draft, criticised and edited: ``out`` is a struct of text, points and whether the editor was left out.

    The editor sees the first ``keep`` points. Without a list, or with an empty one, the draft
    stays; an empty draft is not criticised.
    """
    do = Steps(df)
    draft = do.put(draft)
    found = do.put(F.slice(points(do.call(critic, "Nenne die Schwächen als JSON-Liste.", ("Sprache", language), ("Entwurf", draft))), 1, keep))
    skipped = do.put(F.coalesce(F.size(found) < 1, F.lit(True)) | (draft == ""))
    few = F.when(F.size(found) == 1, "nur diese 1 Stelle ändern").otherwise(F.concat(F.lit("nur diese "), F.size(found).cast("string"), F.lit(" Stellen ändern")))
    edited = do.call(editor, task, ("Sprache", language), ("Entwurf", draft), ("Kritikpunkte", F.concat(few, F.lit("\n"), F.array_join(found, "\n"))))
    return do.done(out, F.struct(F.when(skipped, draft).otherwise(edited).alias("text"), F.when(~skipped, found).alias("points"), skipped.alias("skipped")))


def supervised(df: DataFrame, out: str, talk: Column, first: Model, second: Model, reduce: Model) -> DataFrame:
    """Two readings of a conversation and a third call that gets both; a failed call leaves a note."""
    do = Steps(df)
    talk = do.put(talk)

    def called(name: str, model: Model, task: str, *sections: tuple[str, Column]) -> Column:
        return do.put(F.coalesce(do.call(model, task, ("Gespräch", talk), *sections), F.lit(f"[FEHLER: {name}]")))

    manager = called("MANAGER", first, "Zeige, wer das Gespräch lenkt und wie.")
    exile = called("EXILE", second, "Zeige die Brüche des Gesprächs.")
    meta = called("META", reduce, "Begutachte die Beziehung.", ("Lenkung", manager), ("Brüche", exile))
    return do.done(out, F.struct(manager.alias("manager"), exile.alias("exile"), meta.alias("meta")))


def evidence_text(df: DataFrame, out: str, question: Column, sources: Column, speakers: Column, extract: Model, validate: Model, write: Model) -> DataFrame:
    """Quotations of the asked speakers, checked against mentions by others, then written up.

    ``sources`` are structs of speaker and content. ``out`` is null where no quotation is found.
    Where the validator's answer cannot be read, all quotations pass.
    """
    do = Steps(df)
    line = lambda s, i: F.concat(F.lit("SOURCE_ID ["), (i + 1).cast("string"), F.lit("] | SPEAKER: "), F.coalesce(s["speaker"], F.lit("Unbekannt")), F.lit(" | CONTENT: "), F.replace(s["content"], F.lit("\n"), F.lit(" ")))
    listing = F.array_join(F.transform(sources, line), "\n\n")
    task = "Nimm jeden Text der gefragten Sprecher als primary_quotes auf, Erwähnungen durch andere als secondary_mentions."
    extracted = do.put(J.json_of(do.call(extract, task, ("Sprecher", F.array_join(speakers, ", ")), ("Quellen", listing))))
    primary = do.put(F.from_json(F.get_json_object(extracted, "$.primary_quotes"), QUOTES))
    mentions = F.coalesce(F.get_json_object(extracted, "$.secondary_mentions"), F.lit("[]"))
    checked = do.put(J.json_of(do.call(validate, "Widersprechen die Erwähnungen den Zitaten?", ("Zitate", F.to_json(primary)), ("Erwähnungen", mentions))))
    valid = do.put(F.coalesce(F.from_json(F.get_json_object(checked, "$.validated_primary"), QUOTES), primary))
    quoted = do.put(F.array_join(F.transform(valid, lambda q: F.concat(F.lit("["), q["source_id"].cast("string"), F.lit("] "), q["speaker"], F.lit(": "), q["quote"])), "\n"))
    against = do.put(F.coalesce(F.get_json_object(checked, "$.contradictions"), F.lit("[]")))
    text = do.call(write, "Schreibe den Text aus den geprüften Zitaten.", ("Frage", question), ("Zitate", quoted), ("Widersprüche", against))
    return do.done(out, F.when(F.size(primary) > 0, text))


def facts(df: DataFrame, out: str, chunks: Column, model: Model) -> DataFrame:
    """Atomic facts that a model lists from chunks (structs of date, speaker, role and content).

    The prompt holds whole contents; ``source_id`` of a fact counts chunks from 0. ``out`` is
    null where there are no chunks or the answer cannot be read.
    """
    do = Steps(df)
    unknown = F.lit("None")
    line = lambda c, i: F.concat(
        F.lit("--- CHUNK ID "), i.cast("string"), F.lit(" ---\nMetadaten: Datum="), F.coalesce(c["date"], unknown), F.lit(", Modell="), F.coalesce(c["speaker"], unknown), F.lit(", Rolle="), F.coalesce(c["role"], unknown), F.lit("\nInhalt: "), c["content"]
    )
    answer = do.call(model, "Liste die Kernaussagen als JSON.", ("Chunks", F.array_join(F.transform(chunks, line), "\n")))
    return do.done(out, F.when(F.size(chunks) > 0, F.from_json(do.put(J.json_of(answer)), FACTS)))


def vision_call(images: Column, question: Column, origin: Column, instruction: str, rules: Mapping[str, str], limit: int = IMAGE_BYTES) -> Column:
    """A call with images (structs of bytes and mime): struct of instruction and parts, images first.

    The rule of the images' origin follows the instruction. An empty question gets one by the
    number of images. Null without images or with more than ``limit`` bytes in all.
    """
    total = F.aggregate(images, F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x["bytes"]))
    rule = F.lit(None).cast("string")
    for name, said in rules.items():
        rule = F.when(origin == name, said).otherwise(rule)
    asked = F.when(F.coalesce(question, F.lit("")) != "", question).when(F.size(images) >= 2, "Analysiere und vergleiche die Bilder.").otherwise("Analysiere das Bild.")
    none = F.lit(None)
    parts = F.concat(
        F.transform(images, lambda x: F.struct(x["mime"].alias("mime"), x["bytes"].alias("bytes"), none.cast("string").alias("text"))),
        F.array(F.struct(none.cast("string").alias("mime"), none.cast("binary").alias("bytes"), asked.alias("text"))),
    )
    return F.when((F.size(images) > 0) & (total <= limit), F.struct(F.concat_ws("\n\n", F.lit(instruction), rule).alias("instruction"), parts.alias("parts")))


def first_path(setting: Column, default: Column, exists: Column, fallback: str) -> Column:
    """The path of a list: the one that is set, else the default if it is there, else ``fallback``."""
    return F.coalesce(F.when(setting != "", setting), F.when(exists, default), F.lit(fallback))


def guarded(df: DataFrame, out: str, said: Column, mode: Column, model: Model, sharper: Model, refusal: str, opening: str = "__START__", echo: float = 0.6) -> DataFrame:
    """An answer between guards: ``out`` is a struct of answer, route and number of calls.

    A message that says crisis (unless it is the ``opening``) is not answered by the model, and an answer
    that does is replaced. An answer that repeats the message is asked for once more, sharper;
    the second one is only guarded against crisis. A failed call gives an empty answer. A null message
    is empty; the limits depend on the ``mode``.
    """
    do = Steps(df)
    message = do.put(F.coalesce(said, F.lit("")))
    limit = do.put(J.crisis_threshold(mode))
    alarm = lambda text: do.put(F.coalesce(J.folded_score(J.crisis_hits(text), limit) >= limit, F.lit(False)))
    heard = do.put(alarm(message) & (message != opening))
    first = do.put(F.when(~heard, F.coalesce(model(message), F.lit(""))))
    answered = alarm(F.coalesce(first, F.lit("")))
    echoes = lambda answer: F.coalesce(J.echo_overlap(message, answer) >= echo, F.lit(False))
    again = do.put(~heard & ~answered & echoes(first))
    second = do.put(F.when(again, F.coalesce(sharper(message), F.lit(""))))
    worse = alarm(F.coalesce(second, F.lit("")))
    route = F.when(heard, "crisis in message").when(answered, "crisis in answer").when(worse, "crisis in second answer").when(again & echoes(second), "still an echo").when(again, "second answer").otherwise("answer")
    answer = F.when(heard | answered | worse, refusal).otherwise(F.coalesce(second, first))
    return do.done(out, F.struct(answer.alias("answer"), route.alias("route"), F.when(heard, 0).when(again, 2).otherwise(1).alias("calls")))


def last_said(turns: DataFrame, chat: str = "chat_id", turn: str = "turn", role: str = "role", content: str = "content") -> DataFrame:
    """``turns`` with ``said``: the user turn before each turn, wherever other turns stand between them."""
    before = W.partitionBy(chat).orderBy(turn).rowsBetween(W.unboundedPreceding, -1)
    return turns.withColumn("said", F.last(F.when(F.col(role) == "user", F.col(content)), ignorenulls=True).over(before))


def phases(drafts: DataFrame, draft: str, n_sources: Column, go_on: Model, correct: Callable[[Column, Column], Column], errors: Callable[[Column], Column], rounds: int = 2) -> DataFrame:
    """Drafts brought to an end: ``draft`` is replaced, ``continued`` and ``corrected`` say in how many rounds.

    A draft that breaks off goes on from its last whole paragraph, at most ``rounds`` times; one with
    ``errors`` (a list) is corrected until none are left, at most ``rounds`` times, and a correction
    that loses a fifth of the length or the last source's heading is refused, which ends
    the attempts. Only unfinished drafts are worked on; the lineage is cut after every round.
    """
    todo = drafts.withColumns({"continued": F.lit(0), "corrected": F.lit(0)})
    done: list[DataFrame] = []

    def loop(todo: DataFrame, name: str, finished: Callable[[DataFrame], Column], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
        done.clear()
        for _ in range(rounds):
            held = settle(todo.withColumn("__end", F.coalesce(finished(todo), F.lit(True))))
            done.append(held.filter("__end").drop("__end"))
            todo = held.filter("not __end").drop("__end")
            if todo.isEmpty():
                break
            todo = step(todo).withColumn(name, F.col(name) + 1)
        return settle(functools.reduce(DataFrame.unionByName, [*done, todo.select(*done[0].columns)]))

    def longer(df: DataFrame) -> DataFrame:
        kept = J.truncated(F.col(draft), n_sources)["complete"]
        more = F.coalesce(go_on(kept), F.lit(""))
        return df.withColumn(draft, F.when(more != "", F.concat(F.rtrim(kept), F.lit("\n\n"), F.ltrim(more))).otherwise(kept))

    def better(df: DataFrame) -> DataFrame:
        new = correct(F.col(draft), errors(F.col(draft)))
        fits = F.coalesce((F.length(new) >= 0.8 * F.length(draft)) & F.contains(new, F.concat(F.lit("QUELLE ["), n_sources.cast("string"), F.lit("]"))), F.lit(False))
        return df.withColumns({draft: F.when(fits, new).otherwise(F.col(draft)), "__refused": F.col("__refused") | ~fits})

    whole = loop(todo, "continued", lambda _: ~J.truncated(F.col(draft), n_sources)["is_truncated"], longer)
    ended = loop(whole.withColumn("__refused", F.lit(False)), "corrected", lambda _: (F.size(errors(F.col(draft))) == 0) | F.col("__refused"), better)
    return ended.withColumn("refused", F.col("__refused")).drop("__refused")
