"""Model calls as table transformations.  A responder maps (key, prompt) rows to (key, response, error, attempts).

``replay`` answers from a table, for tests and reruns; ``http_responder`` asks a chat endpoint, one client a task.
``run_stage`` adds the checks of the stage and asks again with the errors, as often as configured.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrasto.sources.tables import materialize

Responder = Callable[[DataFrame], DataFrame]
ANSWER = "key string, response string, error string, attempts int"
# ---- fixed values: statuses worth another attempt
RETRY = [408, 409, 425, 429, 500, 501, 502, 503, 504]


def replay(answers: DataFrame) -> Responder:
    """answers: key, attempt, response.  The answer of the attempt asked for; an error where there is none."""

    def respond(asked: DataFrame) -> DataFrame:
        known = answers.select("key", "attempt", "response")
        out = asked.join(known, ["key", "attempt"], "left")
        return out.select("key", "response", F.when(F.col("response").isNull(), "no recorded answer").alias("error"), F.lit(1).alias("attempts"))

    return respond


def message_text(message: dict) -> str:
    """The text of a chat message: a string, or parts with text."""
    content = message.get("content")
    if isinstance(content, list):
        return "".join(p.get("text") or "" for p in content if isinstance(p, dict))
    return content or ""


def parse_headers(values: list[str]) -> dict[str, str]:
    """Headers given as ``NAME=VALUE`` (the value as it stands) or ``NAME: VALUE``."""
    out = {}
    for v in values:
        m = re.fullmatch(r"\s*([^=:]*?)\s*([=:])(.*)", v, re.DOTALL)
        if not m or not m[1]:
            raise ValueError(f"a header needs the form NAME=VALUE, not {v!r}")
        out[m[1]] = m[3] if m[2] == "=" else m[3].strip()
    return out


def http_responder(url: str, model: str | None = None, system: str = "", headers: dict[str, str] | None = None, retries: int = 2, timeout: float = 120.0, pause: float = 1.0, send=urllib.request.urlopen, **options) -> Responder:
    """Asks a chat completions endpoint for every row; failures become rows with ``error``."""

    def ask(prompt: str) -> tuple[str | None, str | None, int]:
        body = {"messages": [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": prompt}], **options} | ({"model": model} if model else {})
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
        for k in range(retries + 1):
            try:
                with send(request, timeout=timeout) as reply:
                    choice = json.load(reply)["choices"][0]
                    if choice.get("finish_reason") not in (None, "stop"):
                        raise ValueError(f"the answer ended by {choice['finish_reason']}")
                    return message_text(choice["message"]), None, k + 1
            except urllib.error.HTTPError as e:
                error, again = f"HTTP {e.code}", e.code in RETRY
            except (OSError, ValueError, KeyError, IndexError) as e:
                error, again = f"{type(e).__name__}: {e}", True
            if not again:
                break
            time.sleep(pause * 2**k)
        return None, error, k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [ask(p) for p in b.column("prompt").to_pylist()]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], names=["key", "response", "error", "attempts"])

    return lambda asked: asked.select("key", "prompt").mapInArrow(run, ANSWER)


def run_stage(tasks: DataFrame, responder: Responder, parse: Callable[[Column], Column], check: Callable[[DataFrame], Column], retries: int = 1) -> DataFrame:
    """tasks: key, prompt and what ``check`` reads.  Rows: key, status, value, errors, rounds.

    ``parse`` makes the value from a response (null if it can't), ``check`` an array of errors from the columns of
    tasks and value.  Rows with errors are asked again with these, ``retries`` times.  The rows of a round are written before
    they are read, so a model is asked once for each prompt however often its answer is used.
    """
    done: DataFrame | None = None
    todo = tasks.withColumn("attempt", F.lit(1))
    for k in range(1, retries + 2):
        got = responder(todo.select("key", "prompt", "attempt")).select("key", F.col("response").alias("_r"), F.col("error").alias("_e"))
        got = materialize(got, "answers")
        rows = todo.join(got, "key", "left").withColumn("value", parse(F.col("_r")))
        errors = F.when(F.col("_e").isNotNull(), F.array("_e")).when(F.col("value").isNull(), F.array(F.lit("not a JSON object"))).otherwise(check(rows))
        rows = materialize(rows.withColumn("errors", errors).withColumn("status", F.when(F.size("errors") == 0, "success").otherwise("error")).withColumn("rounds", F.lit(k)), "round")
        final = rows if k > retries else rows.where("status = 'success'")
        final = final.select("key", "status", "value", "errors", "rounds")
        done = final if done is None else done.unionByName(final)
        again = rows.where("status = 'error'").withColumn("prompt", F.concat("prompt", F.lit("\n\nYour last answer was rejected: "), F.array_join("errors", "; ")))
        todo = again.select(*tasks.columns).withColumn("attempt", F.lit(k + 1))
    return done
