"""Calls of a model that may fail: tries with back-off, answers that break off, rows of failure.

A model is a function of a list of prompts and the number of the try, and gives a list of
answers; an exception among them, or raised, is the failure of its prompts. Only prompts
without an answer are tried again. No failure ends a task: it stands in the row.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

Model = Callable[[list[str], int], list[str | Exception | None]]
ANSWER = "answer string, tries int, waited double, error string"
BATCH = 32


@dataclass(frozen=True)
class Retry:
    """Try ``k`` (from 0) waits ``empty * 2^k`` after an empty answer and ``error * 2^k`` after an error;
    an answer that breaks off waits ``cut * (k + 1)``."""

    tries: int = 3
    empty: float = 1.5
    error: float = 2.0
    cut: float = 0.5


def no_wait(seconds: float) -> None:
    """In place of ``time.sleep``, where waits are only to be counted."""


def _asked(model: Model, prompts: list[str], k: int) -> list[str | Exception | None]:
    try:
        answers = model(prompts, k)
        return answers if len(answers) == len(prompts) else [ValueError(f"{len(answers)} answers to {len(prompts)} prompts")] * len(prompts)
    except Exception as error:  # noqa: BLE001 - whatever a model raises is the failure of its prompts
        return [error] * len(prompts)


def tried(model: Model, prompts: list[str], retry: Retry, sleep: Callable[[float], None], whole: Callable[[str], bool] = lambda _: True) -> list[tuple[str, int, float, str | None]]:
    """(answer, tries, waited, error) of each prompt; an answer that is not ``whole`` is asked for again, the last one stays."""
    out: list[tuple[str, int, float, str | None]] = [("", 0, 0.0, None)] * len(prompts)
    left = list(range(len(prompts)))
    for k in range(retry.tries):
        waits, again = [], []
        for i, said in zip(left, _asked(model, [prompts[i] for i in left], k), strict=True):
            failed = isinstance(said, Exception)
            empty = not failed and not (said or "").strip()
            if not failed and not empty and whole(said):
                out[i] = (said, k + 1, out[i][2], None)
                continue
            wait = retry.error * 2**k if failed else retry.empty * 2**k if empty else retry.cut * (k + 1)
            error = f"{type(said).__name__}: {said}" if failed else "empty" if empty else "cut off"
            out[i] = ("" if failed or empty else said, k + 1, out[i][2] + wait, error)
            waits.append(wait)
            again.append(i)
        left = again
        if not left:
            break
        sleep(max(waits))
    return out


def call(rows: DataFrame, prompt: Column, model: Model, out: str = "call", retry: Retry = Retry(), sleep: Callable[[float], None] = time.sleep, whole: Callable[[str], bool] = lambda _: True) -> DataFrame:
    """``rows`` with a struct of answer, tries, seconds waited and error; a null prompt is not asked."""
    asked = rows.withColumn("__prompt", prompt)
    at = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("answer", pa.string()), ("tries", pa.int32()), ("waited", pa.float64()), ("error", pa.string())])
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                prompts = part.column(at).to_pylist()
                found = iter(tried(model, [p for p in prompts if p is not None], retry, sleep, whole))
                made = [None if p is None else dict(zip(("answer", "tries", "waited", "error"), next(found), strict=True)) for p in prompts]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(made, kind)], names=[*part.schema.names[:at], out])

    return asked.mapInArrow(run, S.StructType([*rows.schema.fields, S.StructField(out, S.StructType.fromDDL(ANSWER))]))


def parsed(text: str):
    """The JSON value of an answer: as it is, in a fence, or from the first to the last bracket; ValueError if there is none."""
    tries = [text.strip()]
    if fence := re.search(r"```(?:json)?(.*?)```", text, re.S):
        tries.append(fence.group(1).strip())
    tries += [m.group(0) for p in (r"\[.*\]", r"\{.*\}") if (m := re.search(p, text, re.S))]
    for one in tries:
        try:
            return json.loads(one)
        except ValueError:
            continue
    raise ValueError("no JSON")


def brackets(text: str) -> tuple[int, list[str], bool, list[tuple[int, str]]]:
    """Where the first bracket of a text stands (-1: nowhere), the brackets open at its end, whether a string
    is, and the places behind which it could be cut, with the brackets that would close it there."""
    start = next((i for i, c in enumerate(text) if c in "[{"), -1)
    stack: list[str] = []
    places: list[tuple[int, str]] = []
    inside = escaped = False
    for i in range(start, len(text)) if start >= 0 else ():
        c = text[i]
        if inside:
            inside, escaped = (True, False) if escaped else (c != '"', c == "\\")
        elif c == '"':
            inside = True
        elif c == ",":
            places.append((i, _closing(stack)))
        elif c in "[{":
            stack.append(c)
            places.append((i + 1, _closing(stack)))
        elif c in "]}" and stack and stack[-1] + c in ("[]", "{}"):
            stack.pop()
    return start, stack, inside, places


def _closing(stack: list[str]) -> str:
    return "".join("]" if c == "[" else "}" for c in reversed(stack))


def cut_off(text: str) -> bool:
    """Whether an answer begins a JSON value and does not end it."""
    _, stack, inside, _ = brackets(text)
    return bool(stack) or inside


def closed(text: str) -> str:
    """An answer that breaks off, cut back to its last whole member and with its open brackets closed."""
    start, stack, inside, places = brackets(text)
    if start < 0 or not stack and not inside:
        return text
    for end, tail in [(len(text), '"' * inside + _closing(stack)), *reversed(places)]:
        one = text[start:end].rstrip().rstrip(",") + tail
        try:
            json.loads(one)
            return one
        except ValueError:
            continue
    return text


def call_json(rows: DataFrame, prompt: Column, model: Model, schema: str, out: str = "value", retry: Retry = Retry(), sleep: Callable[[float], None] = time.sleep, repair: bool = True) -> DataFrame:
    """``rows`` with a struct of value (by the schema), tries, waited and error.

    Answers that break off are asked for again; with ``repair`` the last one is closed. The value is null
    where no JSON is found or none of the schema's fields fits.
    """
    called = call(rows, prompt, model, "__call", retry, sleep, lambda x: not (cut_off(x) and not _is_json(x)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for one in batch.column(batch.schema.get_field_index("__call")).to_pylist():
                found.append(_read((one or {}).get("answer") or "", repair))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "__json"])

    texts = called.mapInArrow(read, S.StructType([*called.schema.fields, S.StructField("__json", S.StringType())]))
    value = F.from_json("__json", schema)
    names = S.StructType.fromDDL(schema).names
    fits = reduce(Column.__or__, [F.coalesce(value[n].isNotNull(), F.lit(False)) for n in names])
    c = F.col("__call")
    error = F.when(c["error"].isNotNull() & F.col("__json").isNull(), c["error"]).when(F.col("__json").isNull() & c["answer"].isNotNull(), "no JSON").when(c["answer"].isNotNull() & ~fits, "not of the schema")
    return texts.select(*rows.columns, F.struct(F.when(fits, value).alias("value"), c["tries"].alias("tries"), c["waited"].alias("waited"), error.alias("error")).alias(out))


def _is_json(text: str) -> bool:
    try:
        parsed(text)
        return True
    except ValueError:
        return False


def _read(text: str, repair: bool) -> str | None:
    for one in (text, closed(text)) if repair else (text,):
        try:
            return json.dumps(parsed(one), ensure_ascii=False)
        except ValueError:
            continue
    return None
