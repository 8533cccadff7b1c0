"""The first JSON object that can be read in free text."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = re.compile(r"^```(?:json)?[ \t]*|```[ \t]*$", re.M)
#: Everything that can change the scan's state.
SIGNS = re.compile(r'["\\{}]')
#: A string, to its end or the text's, or a brace outside strings. Escapes count within strings only.
TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|[{}]'
#: White space as Python strips it.
BLANK = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def first_object(text: str | None) -> dict | None:
    """The first balanced {...} that parses; later ones are tried when an earlier one doesn't. For Python tasks; see extract_json().

    Quotes open and close strings wherever they stand, also in prose, and braces within strings
    don't count; so an odd quote or an unclosed brace hides what comes after it.
    """
    text = FENCE.sub("", (text or "").strip())
    depth = begin = at = 0
    quoted = False
    while sign := SIGNS.search(text, at):
        at, c = sign.end(), sign.group()
        if c == "\\":
            at += quoted  # an escape takes the next character with it, in strings only
        elif c == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif c == "{":
            begin = begin if depth else sign.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                try:
                    found = json.loads(text[begin:at])
                except ValueError:
                    continue
                if isinstance(found, dict):
                    return found
    return None


def unfenced(text: Column) -> Column:
    """Text without white space around it, and without the fences that lines then begin or end with."""
    bare = F.trim(text, F.lit(BLANK))
    return F.when(bare.contains("```"), F.regexp_replace(bare, r"(?md)^```(?:json)?[ \t]*|```[ \t]*$", "")).otherwise(bare)


def extract_json(text: Column | str) -> Column:
    """The same object as its JSON text, as it stands; null if there is none, or no text.

    A fold over strings and the braces between them: it carries the depth and the place where the
    outermost brace opened, and tries what lies between that and the brace that closes it.
    """
    text = F.col(text) if isinstance(text, str) else text
    # An array of one binds the bare text, so that no step of the fold makes it again.
    return F.when(text.contains("{"), F.get(F.transform(F.array(unfenced(text)), _first_object), F.lit(0)))


def _first_object(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    gaps = F.transform(F.split(text, TOKEN, -1), F.length)
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("begin"), F.lit(None).cast("string").alias("found"))

    def step(s: Column, m: Column) -> Column:
        at, depth, opens = s["at"] + m["gap"], s["depth"], m["token"] == "{"
        closes = (m["token"] == "}") & (depth > 0)
        whole = F.substring(text, s["begin"] + 1, at + 1 - s["begin"])
        # What doesn't begin as an object needs no parser to say so.
        read = F.when(whole.rlike(r'^\{\s*["}]'), F.from_json(whole, "MAP<STRING, STRING>", {"allowSingleQuotes": "false"}))
        return F.struct(
            (at + F.length(m["token"])).alias("at"),
            F.when(opens, depth + 1).when(closes, depth - 1).otherwise(depth).alias("depth"),
            F.when(opens & (depth == 0), at).otherwise(s["begin"]).alias("begin"),
            F.when(closes & (depth == 1) & s["found"].isNull(), F.when(read.isNotNull(), whole)).otherwise(s["found"]).alias("found"),
        )

    moves = F.zip_with(tokens, F.slice(gaps, F.lit(1), F.size(tokens)), lambda token, gap: F.struct(gap.alias("gap"), token.alias("token")))
    return F.aggregate(moves, begin, step, lambda s: s["found"])
