"""One question's session: the tools an answer may use, what they have shown, and the checked answer as events.

A session is the driver's: it holds ids of at most ``cap`` paragraphs per call. The handler that decides which tools to
call is a port; ``Scripted`` calls given ones.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import lookup, retrieval

HITS = 6
_TEXT, _NUMBER = {"type": "string"}, {"type": "integer"}


class Event(NamedTuple):
    kind: str
    data: dict


class Handler(Protocol):
    def answer(self, question: str, tools: Tools) -> Iterator[Event]: ...


def tool_schemas() -> dict[str, dict]:
    """The tools' arguments as JSON schemas."""
    made = {
        "search": ({"q": _TEXT, "kinds": {"type": "array", "items": _TEXT}}, ["q"]),
        "get_unit": ({"unit_id": _NUMBER}, ["unit_id"]),
        "get_paragraphs": ({"document_id": _TEXT, "first": _NUMBER, "last": _NUMBER}, ["document_id", "first", "last"]),
        "get_document": ({"document_id": _TEXT}, ["document_id"]),
    }
    return {name: {"type": "object", "properties": p, "required": r, "additionalProperties": False} for name, (p, r) in made.items()}


class Tools:
    """Read-only tools over the tables; ``seen`` grows by every paragraph that one returns."""

    def __init__(self, tables: dict[str, DataFrame], vector_of: Callable[[str], Sequence[float]], cap: int = lookup.PAGE):
        self.tables, self.vector_of, self.cap, self.seen = tables, vector_of, cap, set()

    def call(self, name: str, arguments: dict) -> tuple[dict, int]:
        """(result, how many paragraphs it showed that the session had not seen); an unknown tool is an error."""
        before = len(self.seen)
        if name not in tool_schemas():
            return {"error": f"no tool {name}"}, 0
        try:
            return getattr(self, name)(**arguments), len(self.seen) - before
        except (TypeError, ValueError) as e:  # malformed arguments
            return {"error": str(e)}, len(self.seen) - before

    def _shown(self, rows: list) -> list[dict]:
        ids = [r["pid"] for r in rows]
        self.seen.update(ids)
        where = {r["pid"]: r["location"] for r in self._locations(ids).collect()}
        return [{"paragraph_id": r["pid"], "position": r["position"], "where": where.get(r["pid"]), "text": r["text"]} | ({"kind": r["block_kind"]} if r["block_kind"] else {}) for r in rows]

    def _locations(self, ids: Sequence[int]) -> DataFrame:
        t = self.tables
        return lookup.locations(t["paragraphs"].where(F.col("pid").isin(list(ids))), t["units"], t["revisions"], t["papers"])

    def search(self, q: str, kinds: Sequence[str] | None = None) -> dict:
        hits = retrieval.hydrate(retrieval.search(self.tables, q, self.vector_of(q), k=HITS, kinds=kinds or None), self.tables)
        found = hits.orderBy(F.desc("score"), "item_type", "item_id").collect()
        return {"results": [{"unit_id": h["item_id"] if h["item_type"] == "unit" else None, "document_id": h["paper_id"], "document": h["name"], "paragraphs": self._shown(h["paragraphs"][: self.cap])} for h in found]}

    def get_unit(self, unit_id: int) -> dict:
        row = lookup.current_units(self.tables["units"], self.tables["revisions"]).where(F.col("unit_id") == int(unit_id)).select("paper_id", "first_pos", "last_pos").first()
        return self.get_paragraphs(*row) if row else {"error": f"unit {unit_id} is unknown or not current"}

    def get_paragraphs(self, document_id: str, first: int, last: int) -> dict:
        rev = retrieval.current(self.tables["revisions"]).where(F.col("paper_id") == document_id)
        p = self.tables["paragraphs"].where(F.col("position").between(int(first), min(int(last), int(first) + self.cap - 1))).join(rev, "revision_id")
        rows = p.select("pid", "position", "block_kind", "text").orderBy("position", "pid").collect()
        return {"paragraphs": self._shown(rows)} if rows else {"error": f"nothing at positions {first} to {last} of {document_id}"}

    def get_document(self, document_id: str) -> dict:
        t = self.tables
        row = lookup.document_counts(t["paragraphs"], t["revisions"].where(F.col("paper_id") == document_id), t["papers"]).first()
        if row is None:
            return {"error": f"document {document_id} is unknown or not ready"}
        rev = retrieval.current(t["revisions"]).where(F.col("paper_id") == document_id).select("revision_id")
        outline = lookup.outline(t["paragraphs"].join(rev, "revision_id", "left_semi")).orderBy("first_pos").collect()
        return {"document": row["name"], "paragraphs": row["paragraphs"], "outline": [{"section": list(o["section_path"] or []), "first_paragraph": o["first_pos"], "page": o["page"]} for o in outline]}


class Scripted:
    """A handler that calls given tools and gives a given reply (or none)."""

    def __init__(self, calls: Sequence[tuple[str, dict]], reply: dict | None, error: str | None = None):
        self.calls, self.reply, self.error = calls, reply, error

    def answer(self, question: str, tools: Tools) -> Iterator[Event]:
        for name, arguments in self.calls:
            yield Event("tool_call", {"tool": name, "input": arguments})
            result, new = tools.call(name, arguments)
            yield Event("tool_result", {"tool": name, "input": arguments, "new_paragraphs": new, "error": result.get("error")})
        if self.error is not None:
            yield Event("error", {"error": self.error})
        elif self.reply is not None:
            yield Event("answer", self.reply)


def checked(reply: dict, tools: Tools) -> dict:
    """The answer, and its citations in order: rendered, or with the reason why they are removed."""
    asked = [(k, c["paragraph_id"]) for k, c in enumerate(reply["citations"])]
    spark = tools.tables["papers"].sparkSession
    cited = spark.createDataFrame(asked, "marker long, pid long")
    seen = spark.createDataFrame([(i,) for i in sorted(tools.seen)], "pid long")
    rows = {r["marker"]: r for r in lookup.check_citations(cited, seen, tools._locations([pid for _, pid in asked])).collect()}
    shown = [{**c, "rendered": rows[k]["location"], "removed": rows[k]["removed"]} for k, c in enumerate(reply["citations"])]
    return {"answer": reply["answer"], "citations": shown}


@contextmanager
def recorded(question: str, tools: Tools, log: Callable[[dict], None]) -> Iterator[dict]:
    """An entry to be filled in, which is logged at the end, whichever way that comes."""
    began, entry = time.monotonic(), {"question": question, "outcome": "stopped", "tool_calls": 0}
    try:
        yield entry
    finally:
        log(entry | {"seconds": round(time.monotonic() - began, 1), "paragraphs_read": len(tools.seen)})


def ask(handler: Handler, tools: Tools, question: str, log: Callable[[dict], None] = lambda entry: None) -> Iterator[Event]:
    """The handler's events, then ``final`` if it answered. ``log`` gets one entry with the outcome: answered, error,
    no_answer, or stopped if the caller leaves early."""
    with recorded(question, tools, log) as entry:
        last: dict[str, dict] = {}
        for event in handler.answer(question, tools):
            last[event.kind] = event.data
            entry["tool_calls"] += event.kind == "tool_call"
            yield event
        if "answer" in last:
            final = checked(last["answer"], tools)
            entry |= {"outcome": "answered", "citations": len(final["citations"]), "removed": sum(c["removed"] is not None for c in final["citations"])}
            yield Event("final", final)
        else:
            entry |= {"outcome": "error", **last["error"]} if "error" in last else {"outcome": "no_answer"}


def server_sent(events: Iterator[Event]) -> Iterator[str]:
    """Events as the lines of a server-sent stream."""
    for e in events:
        yield f"event: {e.kind}\ndata: {json.dumps(e.data, ensure_ascii=False)}\n\n"
