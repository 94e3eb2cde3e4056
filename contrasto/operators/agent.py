"""A web agent as a table of conversations: a model that may search and open pages until it answers.

A task runs the conversations of its rows, each until an answer or the end of its steps; the rows are written, judged as a table
by ``verification``, and those whose answer was wrong go on with the errors, as often as configured.  The chat endpoint, the search and the
fetch are functions, so recorded ones serve tests and reruns.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasto.operators import verification
from contrasto.sources.tables import materialize

Chat = Callable[[list[dict]], dict]
STATE = "subgraph_id string, messages string, trace struct<searches:array<string>,fetches:array<struct<requested_url:string,url:string,text:string>>,finals:array<string>>"
# What a model may call.
TOOLS = [
    {"type": "function", "function": {"name": "WebSearch", "description": "Search the public web.", "parameters": {"type": "object", "properties": {"query": {"type": "string"}}, "required": ["query"]}}},
    {"type": "function", "function": {"name": "WebFetch", "description": "Open a public web page and read its text.", "parameters": {"type": "object", "properties": {"url": {"type": "string"}}, "required": ["url"]}}},
]


def http_chat(url: str, model: str | None = None, system: str = "", headers: dict[str, str] | None = None, timeout: float = 600.0, send=urllib.request.urlopen, **options) -> Chat:
    """One message of a chat completions endpoint that knows tools."""

    def chat(messages: list[dict]) -> dict:
        body = {"messages": [{"role": "system", "content": system}] * bool(system) + messages, "tools": TOOLS, **options} | ({"model": model} if model else {})
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
        with send(request, timeout=timeout) as reply:
            return json.load(reply)["choices"][0]["message"]

    return chat


def converse(messages: list[dict], trace: dict, chat: Chat, search: Callable[[str], str], fetch: Callable[[str], dict], config: verification.VerificationConfig) -> None:
    """Go on with a conversation until the model answers or its steps are used up; budgets hold over all rounds."""

    def use(name: str, given: dict) -> str:
        if name == "WebSearch":
            if len(trace["searches"]) >= config.search_budget:
                return "The search budget is used up."
            trace["searches"].append(str(given.get("query") or ""))
            return search(trace["searches"][-1])
        if name == "WebFetch":
            url = str(given.get("url") or "").strip()
            known = next((f for f in trace["fetches"] if url in (f["requested_url"], f["url"])), None)
            if known is None:
                if len(trace["fetches"]) >= config.fetch_budget:
                    return "The fetch budget is used up."
                page = fetch(url)
                if page.get("error"):
                    return f"The page can't be read: {page['error']}"
                known = {"requested_url": url, "url": page["url"], "text": page["text"]}
                trace["fetches"].append(known)
            return json.dumps({"source_id": f"source-{trace['fetches'].index(known) + 1}", "url": known["url"], "text": known["text"]}, ensure_ascii=False)
        return f"There is no tool {name}."

    for _ in range(config.max_steps):
        try:
            said = chat(messages)
        except (OSError, ValueError, KeyError, IndexError):
            return
        messages.append({"role": "assistant", "content": said.get("content"), **({"tool_calls": said["tool_calls"]} if said.get("tool_calls") else {})})
        if not said.get("tool_calls"):
            trace["finals"].append(str(said.get("content") or ""))
            return
        for call in said["tool_calls"]:
            try:
                given = json.loads(call["function"].get("arguments") or "{}")
            except ValueError:
                given = {}
            messages.append({"role": "tool", "tool_call_id": call.get("id", ""), "content": use(call["function"]["name"], given if isinstance(given, dict) else {})})


def web_traces(tasks: DataFrame, chat: Chat, search: Callable[[str], str], fetch: Callable[[str], dict], config: verification.VerificationConfig = verification.VerificationConfig()) -> DataFrame:
    """tasks: subgraph_id, prompt, qa, documents.  Rows: subgraph_id, trace, as ``verification.judge_traces`` reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                messages, trace = json.loads(r["messages"]), r["trace"] or {"searches": [], "fetches": [], "finals": []}
                converse(messages, trace, chat, search, fetch, config)
                yield pa.RecordBatch.from_pylist([{"subgraph_id": r["subgraph_id"], "messages": json.dumps(messages, ensure_ascii=False), "trace": trace}], schema=_ARROW)

    first = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))))
    state = tasks.select("subgraph_id", first.alias("messages"), F.lit(None).cast(_kind("trace")).alias("trace"))
    done = None
    for k in range(config.final_retries + 1):
        # written, so that a conversation is held once
        state = materialize(state.mapInArrow(run, STATE), "conversations")
        if k == config.final_retries:
            break
        judged = verification.judge_traces(tasks.join(state.select("subgraph_id", "trace"), "subgraph_id"), replace(config, final_retries=k))
        wrong = materialize(judged.where("status = 'error' AND attempts > 0").select("subgraph_id", "error"), "wrong")
        right = state.join(wrong, "subgraph_id", "left_anti")
        done = right if done is None else done.unionByName(right)
        asked = F.to_json(F.struct(F.lit("user").alias("role"), F.concat(F.lit("Your last answer was rejected: "), "error", F.lit("\nReply with one corrected JSON object.")).alias("content")))
        state = state.join(wrong, "subgraph_id").select("subgraph_id", F.concat(F.expr("left(messages, length(messages) - 1)"), F.lit(", "), asked, F.lit("]")).alias("messages"), "trace")
    out = state if done is None else done.unionByName(state)
    return out.select("subgraph_id", "trace")


def _kind(name: str) -> str:
    return STATE.split(f"{name} ", 1)[1]


_ARROW = pa.schema([
    ("subgraph_id", pa.string()), ("messages", pa.string()),
    ("trace", pa.struct([("searches", pa.list_(pa.string())), ("fetches", pa.list_(pa.struct([(n, pa.string()) for n in ("requested_url", "url", "text")]))), ("finals", pa.list_(pa.string()))])),
])
