"""JSON of any depth: the standard parser where it can, loops in place of recursion where it can't."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def loads(text: str, strict: bool = True) -> object:
    """The value of a JSON text; ValueError for invalid JSON (also NaN and Infinity), never RecursionError.

    strict=False lets control characters stand in strings.
    """
    try:
        return json.loads(text, parse_constant=_refuse, strict=strict)
    except RecursionError:
        value, at = deep_value(text, 0, strict)
        if at != len(text):
            raise ValueError(f"more behind the value at {at}") from None
        return value


def _scalar(text: str, at: int, strict: bool) -> tuple[object, int]:
    if text[at : at + 1] == '"':
        return scanstring(text, at + 1, strict)
    for word, value in _WORDS.items():
        if text.startswith(word, at):
            return value, at + len(word)
    number = _NUMBER.match(text, at)
    if not number:
        raise ValueError(f"no value at {at}")
    whole, part, power = number.groups()
    return (float(number.group()) if part or power else int(whole)), number.end()


def _key(text: str, at: int, strict: bool) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError(f"no key at {at}")
    key, at = scanstring(text, at + 1, strict)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return key, _SPACE.match(text, at + 1).end()


def deep_value(text: str, start: int = 0, strict: bool = True) -> tuple[object, int]:
    """The JSON value at `start`, and where the text goes on behind it and its white space; without recursion."""
    at, stack = _SPACE.match(text, start).end(), []
    while True:
        opened = text[at : at + 1]
        if opened in ("{", "["):
            holder: dict | list = {} if opened == "{" else []
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] != ("}" if opened == "{" else "]"):
                key = None
                if opened == "{":
                    key, at = _key(text, at, strict)
                stack.append((holder, key))
                continue
            value, at = holder, at + 1
        else:
            value, at = _scalar(text, at, strict)
        while True:
            at = _SPACE.match(text, at).end()
            if not stack:
                return value, at
            holder, key = stack[-1]
            if key is None:
                holder.append(value)
            else:
                holder[key] = value
            closing = text[at : at + 1]
            if closing == ",":
                at = _SPACE.match(text, at + 1).end()
                if key is not None:
                    key, at = _key(text, at, strict)
                    stack[-1] = (holder, key)
                break
            if closing != ("]" if key is None else "}"):
                raise ValueError(f"no end of a value at {at}")
            stack.pop()
            value, at = holder, at + 1


def canonical(value: object) -> str:
    """The value with sorted keys and no spaces."""
    try:
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except RecursionError:
        return "".join(_pieces(value))


def _pieces(value: object) -> Iterator[str]:
    scalar = lambda x: json.dumps(x, ensure_ascii=False)
    stack: list = [iter([("", value)])]
    ends = [""]
    while stack:
        for lead, x in stack[-1]:
            yield lead
            if isinstance(x, dict) and x:
                yield "{"
                stack.append(iter([(("," if n else "") + scalar(k) + ":", x[k]) for n, k in enumerate(sorted(x))]))
                ends.append("}")
                break
            if isinstance(x, list) and x:
                yield "["
                stack.append(iter([("," if n else "", y) for n, y in enumerate(x)]))
                ends.append("]")
                break
            yield "{}" if isinstance(x, dict) else "[]" if isinstance(x, list) else scalar(x)
        else:
            stack.pop()
            yield ends.pop()


def strings_in(value: object) -> list[str]:
    """All strings of a value in order, without keys."""
    found, stack = [], [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            found.append(x)
        elif isinstance(x, dict):
            stack.extend(reversed(x.values()))
        elif isinstance(x, list):
            stack.extend(reversed(x))
    return found
