"""Trace files cut into records by byte ranges, and what a record says about its calls."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

_DECODER = json.JSONDecoder()
_BLANK = re.compile(r"[ \t\r\n]*")
#: What unreadable text raises; a record nested deeper than the JSON reader goes is unreadable as well.
UNREADABLE = (ValueError, RecursionError)
#: How files hold records: the whole file one, every value of an object, every element of an array.
LAYOUTS = ("single", "keyed", "list")


def _values(text: str) -> Iterator[tuple[object, object, int, int]]:
    """(key or position, value, start, end) of what the outermost array or object of a text holds."""
    at = _BLANK.match(text).end()
    keyed, last = (True, "}") if text[at : at + 1] == "{" else (False, "]")
    if not keyed and text[at : at + 1] != "[":
        raise ValueError("neither an array nor an object")
    at, k = _BLANK.match(text, at + 1).end(), 0
    more = text[at : at + 1] != last
    while more:
        key: object = k
        if keyed:
            key, at = _DECODER.raw_decode(text, at)
            at = _BLANK.match(text, at).end()
            if not isinstance(key, str) or text[at : at + 1] != ":":
                raise ValueError(f"no key before {at}")
            at = _BLANK.match(text, at + 1).end()
        value, end = _DECODER.raw_decode(text, at)
        yield key, value, at, end
        at, k = _BLANK.match(text, end).end(), k + 1
        more = text[at : at + 1] == ","
        if not more and text[at : at + 1] != last:
            raise ValueError(f"no end at {at}")
        at = _BLANK.match(text, at + 1).end()
    if not k:
        at = _BLANK.match(text, at + 1).end()
    if at != len(text):
        raise ValueError(f"more text at {at}")


def _answers(position: int, item: object) -> Iterator[tuple[str, str, object]]:
    """(record_id, path, record) of an element: one for each of its answers, if it lists any."""
    if isinstance(item, dict) and isinstance(item.get("answers"), list):
        for j, answer in enumerate(item["answers"]):
            method = _text(answer.get("method")) if isinstance(answer, dict) else ""
            yield f"list_{position}_{j}_{method}", f"$[{position}].answers[{j}]", {"query": item.get("query", ""), "answer": answer}
    else:
        yield f"list_{position}", f"$[{position}]", item


def records(content: bytes, name: str, layout: str) -> list[tuple[str, str, int, int, object]]:
    """(record_id, path, first byte, bytes, record) of a file's records; of two values under one key the last counts.

    A list in a file of the keyed layout, and an object in one of the list layout,
    is a single record. A range is that of the value that the record stands in.
    """
    text = content.decode("utf-8-sig")
    first = len(content) - len(text.encode())
    opening = text.lstrip(" \t\r\n")[:1]
    if (layout, opening) not in (("keyed", "{"), ("list", "[")):
        return [(name, "$", 0, len(content), json.loads(text))]
    found: dict[str, tuple[str, str, int, int, object]] = {}
    seen, place = 0, first
    for key, value, start, end in _values(text):
        place += len(text[seen:start].encode())
        size = len(text[start:end].encode())
        each = [(_text(key), f"$[{json.dumps(key, ensure_ascii=False)}]", value)] if layout == "keyed" else _answers(key, value)
        found.update({path: (i, path, place, size, record) for i, path, record in each})
        place, seen = place + size, end
    return list(found.values())


def record_at(content: bytes, path: str) -> object:
    """A record from the bytes of its range and its path."""
    item = json.loads(content.decode("utf-8-sig"))
    inner = re.search(r"\]\.answers\[(\d+)\]$", path)
    return {"query": item.get("query", ""), "answer": item["answers"][int(inner[1])]} if inner and not path.startswith('$["') else item


def _text(value: object) -> str:
    return "" if value is None else str(value).strip()


def _tool(name: object) -> str:
    return re.sub("[^a-z0-9]+", "_", unicodedata.normalize("NFKC", _text(name)).casefold()).strip("_")


def _opened(value: object) -> object:
    """JSON inside a string; text that is none stays, a blank one is empty."""
    if not isinstance(value, str):
        return value
    try:
        return json.loads(value.strip() or "{}")
    except UNREADABLE:
        return {"text": value.strip()}


def _filled(value: object) -> bool:
    return value is not None and value not in ("", {}, [])


@dataclass
class Calls:
    """What a chain of calls says: its (service, api) pairs in order, and whether anything stands in arguments, outputs and observations."""

    made: list[tuple[str, str]] = field(default_factory=list)
    arguments: bool = False
    outputs: bool = False
    observations: bool = False
    answer: str = ""
    ended: str = ""

    def call(self, name: str, arguments: object) -> None:
        api, cut, service = _tool(name).rpartition("_for_")
        self.made.append((service, api) if cut else ("", name))
        self.arguments |= _filled(_opened(arguments))

    def answered(self, content: object) -> None:
        self.outputs |= _filled(_opened(content))
        self.observations |= _filled(content)


def _messages(chain: list) -> Calls:
    """Calls of the assistant's messages; a tool's message answers the last call, once, if it bears no other name."""
    calls, open_call = Calls(), None
    for m in (m for m in chain if isinstance(m, dict)):
        role, asked = _text(m.get("role")).casefold(), m.get("function_call")
        if role == "assistant" and isinstance(asked, dict):
            name = _text(asked.get("name"))
            open_call = _tool(name) if name and name.casefold() != "finish" else None
            if open_call is not None:
                calls.call(name, asked.get("arguments"))
            elif name and isinstance(given := _opened(asked.get("arguments")), dict):
                calls.answer, calls.ended = _text(given.get("final_answer")), _text(given.get("return_type"))
        elif role in ("function", "tool") and open_call is not None:
            if not _text(m.get("name")) or _tool(m["name"]) == open_call:
                calls.answered(m.get("content", m.get("message")))
                open_call = None
    return calls


def _final(answer: object) -> str:
    """The final answer of a record: plain text, or a field of the JSON in it."""
    inside = _opened(answer) if isinstance(answer, str) and answer.strip()[:1] == "{" else None
    given = inside if isinstance(inside, dict) and inside != {"text": _text(answer)} else None
    return _text(given.get("final_answer")) if given is not None else _text(answer) if isinstance(answer, str) else ""


def _generated(generation: dict) -> tuple[str, Calls, str]:
    """The chain that the record stands for: the only one that ends in its final answer, the only one there is, or the only one that ends as it does."""
    chains = generation.get("train_messages")
    if not isinstance(chains, list):
        return "unsupported_record_schema", Calls(), "train_messages is no array"
    whole = [c for c in (_messages(c) for c in chains if isinstance(c, list)) if c.made]
    if not whole:
        return "no_ordered_calls", Calls(), "no calls in train_messages"
    target = _final(generation.get("final_answer"))
    ended = {"give_up": "give_up_and_restart"}.get(_text(generation.get("finish_type")), _text(generation.get("finish_type")))
    for picked in ([c for c in whole if target and c.answer == target], whole, [c for c in whole if c.ended and c.ended == ended]):
        if len(picked) == 1:
            return "ok", picked[0], ""
    return "parse_failed", Calls(), f"{len(whole)} chains, none of which stands out"


def _detailed(answer: dict) -> tuple[str, Calls, str]:
    """Calls of tool nodes, along lists and `next` links of any length."""
    if not isinstance(answer.get("answer_details"), list):
        return "unsupported_record_schema", Calls(), "answer_details is no array"
    calls, stack = Calls(), [answer["answer_details"]]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += reversed(node)
        elif isinstance(node, dict):
            stack.append(node.get("next"))
            message = node.get("message")
            if _text(node.get("role")).casefold() == "tool" and isinstance(message, dict):
                name = _text(message.get("name"))
                if name and name.casefold() != "finish":
                    calls.call(name, message.get("arguments"))
                    calls.answered(message.get("response"))
    return ("ok", calls, "") if calls.made else ("no_ordered_calls", calls, "no tool nodes in answer_details")


def parsed(record: object) -> tuple[str, str, Calls, str]:
    """(query, status, calls, error) of a record; status is ok, no_ordered_calls, unsupported_record_schema or parse_failed."""
    if not isinstance(record, dict):
        return "", "parse_failed", Calls(), "no object"
    generation, answer = record.get("answer_generation"), record.get("answer")
    if isinstance(generation, dict):
        return _text(generation.get("query")), *_generated(generation)
    if isinstance(answer, dict):
        return _text(record.get("query")), *_detailed(answer)
    return _text(record.get("query")), "unsupported_record_schema", Calls(), "neither answer_generation nor answer"
