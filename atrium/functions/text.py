"""Text functions: title case, fenced JSON, status icons, file suffixes, prompts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

@F.pandas_udf(StringType())
def title(s: pd.Series) -> pd.Series:
    """Python's title case, which also capitalises after digits and apostrophes; initcap doesn't."""
    return s.str.title()


def label_text(label: Column, exact: bool = True) -> Column:
    """Underscores as blanks, in title case. exact=False stays in the JVM and is the same for letters and blanks."""
    plain = F.replace(label, F.lit("_"), F.lit(" "))
    return title(plain) if exact else F.initcap(plain)


def fenced_block(text: Column) -> Column:
    """The lines between the first fence and the one that closes it, or null.

    A block opens with a line that ends in three backticks, alone or with json after them; blanks at the end don't
    matter, nor what stands before. It closes with a line that begins with three backticks, after one line at least.
    """
    lines = F.split(text, "\n")
    opens = F.transform(lines, lambda x: F.regexp_replace(F.rtrim(x, F.lit(" \t\r\f\x0b")), F.lit("json$"), F.lit("")).endswith("```"))
    first = F.array_position(opens, True)
    rest = F.slice(lines, (first + 1).cast("int"), F.size(lines))
    last = F.array_position(F.transform(rest, lambda x, i: (i > 0) & x.startswith("```")), True)
    return F.when((first > 0) & (last > 0), F.array_join(F.slice(rest, F.lit(1), F.greatest(last - 1, F.lit(0)).cast("int")), "\n"))


def fenced_json(text: Column) -> Column:
    """The whole text as JSON, else its first fenced block, else null, as variant."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(fenced_block(text)))


def status_icon(status: Column) -> Column:
    """Icon of a status line; null for one that isn't shown."""
    icon = F.when(status.startswith("Error"), "ERROR").when(status.startswith("Done") | status.startswith("Sample"), "CHECKMARK").otherwise("INFO")
    return F.when((status != "") & (status != "Ready"), icon)


def suffix(path: Column) -> Column:
    """Lower-case suffix of the last path part, with its dot; empty where there is none, as for dotfiles."""
    return F.regexp_extract(F.lower(path), r"[^./][^/]*?(\.[^./]+)$", 1)


#: What each kind of request asks for, around the JSON that it embeds.
PROMPTS = {
    "furniture": ("Place furniture in the rooms below. Stay inside each polygon, keep doors and walkways clear.", "Answer with JSON only: for each room label, a list of items with name, position, dimensions and rotation."),
    "modification": ("Change the floor plan below as asked. Keep its schema, its outer walls and a way into every room.", "Answer with the whole changed plan as JSON only."),
    "ambiguity": ("Some elements of the floor plan below were detected with low confidence. Decide which are real and correct them.", "Answer with the whole corrected plan as JSON only."),
    "critique": ("Review the floor plan below for living comfort, use and building rules.", "Answer with JSON only: score (1 to 10), strengths, issues with severity, suggestions."),
}


def prompt(kind: str, document: Column, request: Column | None = None) -> Column:
    """The text of a request with the document as JSON; request adds what the user asks, or a report."""
    head, tail = PROMPTS[kind]
    parts = [F.lit(head + "\n\n"), F.to_json(document, {"pretty": "true"}), F.lit("\n\n")]
    if request is not None:
        parts += [F.lit("Request: "), request, F.lit("\n\n")]
    return F.concat(*parts, F.lit(tail))
