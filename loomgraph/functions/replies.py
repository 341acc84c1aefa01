"""JSON in the replies of language models."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import let

#: A token of JSON after blanks: a string, another scalar, or a mark.
TOKEN = re.compile(r"""[ \t\r\n]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|((?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)(?![\w.]))|([][{}:,]))""")
FENCE = re.compile(r"```[^\n]*\n(.*?)\s*```", re.S)
BRACKET = re.compile(r"[{\[]")


def read_value(text: str, start: int, ends: dict[int, int | None]) -> None:
    """Read the JSON value whose bracket is at start, and write down of each bracket met where its value ends, or None for one
    that doesn't end in order. A bracket that is in ends already isn't read again: a value that needs it goes on behind it or
    fails with it. Nothing recurses, so depth doesn't matter."""
    opened: list[int] = []
    at, want = start, "value"
    while True:
        m = TOKEN.match(text, at)
        if not m:
            break
        string, scalar, mark = m.groups()
        at = m.end()
        if mark in ("{", "[") and want.startswith("value"):
            here = m.start(3)
            if here not in ends:
                opened.append(here)
                want = "key or end" if mark == "{" else "value or end"
                continue
            if ends[here] is None:
                break
            at, want = ends[here], "next"
        elif string and want.startswith("key"):
            want = "colon"
        elif (string or scalar) and want.startswith("value"):
            want = "next"
        elif mark == ":" and want == "colon":
            want = "value"
        elif mark == "," and want == "next":
            want = "key" if text[opened[-1]] == "{" else "value"
        elif mark in ("}", "]") and (want == "next" or want.endswith("or end")) and (text[opened[-1]] == "{") == (mark == "}"):
            ends[opened.pop()] = at
            if not opened:
                return
            want = "next"
        else:
            break
    ends.update(dict.fromkeys(opened))


def first_object(text: str | None) -> str | None:
    """The first JSON object or list that a text holds, from the first bracket on that begins one; a list as an object that has it
    under ``items``; null without one, or if all of the text, or of a fence that is all of it, is another JSON value."""
    text, ends = (text or "").strip(), {}
    fenced = FENCE.fullmatch(text)
    other = TOKEN.fullmatch(fenced[1] if fenced else text)
    if other and not other[3]:
        return None
    for m in BRACKET.finditer(text):
        at = m.start()
        if at not in ends:
            read_value(text, at, ends)
        if ends[at] is not None:
            found = text[at : ends[at]]
            return found if found[0] == "{" else f'{{"items": {found}}}'
    return None


def own_object(reply: Column) -> Column:
    """What first_object gives of a reply that is one JSON object or list and nothing else, parsed in the JVM; null of any other."""

    def parsed(bare: Column) -> Column:
        # the JVM's parser stops at the end of a value: that nothing follows shows if a member put behind it is read too
        framed = F.try_parse_json(F.concat(F.lit('{"value": '), bare, F.lit(', "behind it": 1}')))
        whole = ~F.contains(bare, F.lit("behind it")) & F.coalesce(F.try_variant_get(framed, '$["behind it"]', "int") == 1, F.lit(False))
        listed = F.startswith(bare, F.lit("["))
        return F.when((listed | F.startswith(bare, F.lit("{"))) & whole, F.when(listed, F.concat(F.lit('{"items": '), bare, F.lit("}"))).otherwise(bare))

    return let(F.regexp_replace(reply, r"(?U)^\s+|\s+$", ""), parsed)


def json_object(reply: Column, own: Column | None = None) -> Column:
    """first_object as a column. A reply that is nothing but JSON is parsed in the JVM; a worker reads the others, where JSON stands
    within a fence or within prose, or is broken. ``own`` is own_object(reply) if the table has it as a column: it is used twice."""

    @F.pandas_udf("string")
    def run(replies: pd.Series) -> pd.Series:
        return replies.map(first_object, na_action="ignore")

    own = own_object(reply) if own is None else own
    bracket = F.contains(reply, F.lit("{")) | F.contains(reply, F.lit("["))  # nothing is found without
    return F.coalesce(own, run(F.when(own.isNull() & bracket, reply)))


def names_key(reply: Column, key: str) -> Column:
    """False where a reply can't have a key of letters and _: its name isn't there, nor an escape that could stand for a letter of it."""
    return F.contains(reply, F.lit(key)) | F.contains(reply, F.lit("\\u"))


def strings_of(reply: Column, key: str) -> Column:
    """The strings of a list in a JSON object, trimmed; null if the key holds something else, empty without the key."""
    text = lambda v: F.trim(F.variant_get(v, "$", "string"))

    def listed(raw: Column) -> Column:
        found = F.transform(F.filter(F.from_json(raw, "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING"), text)
        return F.when(raw.isNull(), F.array().cast("array<string>")).when(F.startswith(raw, F.lit("[")), found)

    return let(F.when(names_key(reply, key), F.get_json_object(reply, f"$.{key}")), listed)
