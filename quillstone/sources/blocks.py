"""Records inside chat replies: fenced claim lists and fenced documents."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import kind_of

CLAIM = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("why", T.StringType()), T.StructField("refs", T.ArrayType(T.StringType())), T.StructField("entities", T.ArrayType(T.StringType()))]))


def claims_in(reply: Column | str, tag: str = "claims") -> Column:
    """The claims of a reply's last fence with this tag, or of a reply that is a bare array; null if any is bad."""
    reply = F.col(reply) if isinstance(reply, str) else reply
    fences = F.regexp_extract_all(reply, F.lit(rf"(?s)```{re.escape(tag)}[ \t]*\n(.*?)\n?```"), F.lit(1))
    bare = F.when(F.trim(reply, F.lit(" \n\t\r")).startswith("["), F.trim(reply, F.lit(" \n\t\r")))
    body = F.when(F.size(fences) > 0, F.element_at(fences, -1)).otherwise(bare)
    found = F.from_json(body, CLAIM)
    bad = F.exists(found, lambda c: kind_of(c["kind"]).isNull() | (F.trim(F.coalesce(c["text"], F.lit(""))) == ""))
    return F.when(~bad, found)


_FENCE = re.compile(r"^(`{3,}|~{3,})[ \t]*(\S*)[ \t]*$")


def document_in(reply: str | None, tag: str = "spec") -> str | None:
    """The text inside the first fence with this tag, which ends at an equal fence; the whole reply without one."""
    lines = (reply or "").split("\n")
    for i, line in enumerate(lines):
        if (m := _FENCE.match(line.strip())) and m[2] == tag:
            for j in range(i + 1, len(lines)):
                if lines[j].strip() == m[1]:
                    return "\n".join(lines[i + 1 : j])
            return "\n".join(lines[i + 1 :])
    return reply


@F.pandas_udf(T.StringType())
def documents_in(reply: pd.Series) -> pd.Series:
    return reply.map(document_in)
