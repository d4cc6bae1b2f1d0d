"""Table functions for SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql.functions import udtf

from lumenreel.functions import queries as q

_BLANKS = re.compile(r"\s+", re.ASCII)
_LEAD, _VERB = re.compile(r"^[-*]\s*"), re.compile(r"^(?:là|is|are)\s+", re.IGNORECASE)
_CONTEXT, _LABEL, _NUMBER, _SOFT = (re.compile(p) for p in (q.CONTEXT, q.LABEL, q.NUMBER, q.SOFT))


def _clean(text: str) -> str:
    return _VERB.sub("", _LEAD.sub("", _BLANKS.sub(" ", text).strip(" ")).strip(" \t\n\x0b\f\r.:-"))


def _cleaned(texts: list[str]) -> list[str]:
    return [x for x in map(_clean, texts) if x]


def split_events(text: str | None, most: int = 8) -> tuple[str, list[str]]:
    """What told the events apart and the events, as functions.queries.parse_events has them."""
    t = re.sub("\r\n?", "\n", text or "").strip(" ")
    line = t.replace("\n", " ")
    if not t:
        return "empty", []
    if found := _CONTEXT.search(line):
        return "context_relation", _cleaned([found[2], found[1], found[3]])[:most]
    labels = _cleaned(_LABEL.split(t)[1:])
    for source, events in (("event_labels", labels), ("numbered_lines", _cleaned(_NUMBER.split(t)[1:])), ("soft_separators", _cleaned(_SOFT.split(line)))):
        if len(events) > 1:
            return source, events[:most]
    return "single", labels or _cleaned([line])


@udtf(returnType="place int, source string, event string")
class ParseEvents:
    """parse_events(text): a row for each event of a text, for LATERAL joins; a blank text has none."""

    def eval(self, text: str) -> Iterator[tuple[int, str, str]]:
        source, events = split_events(text)
        for place, event in enumerate(events, 1):
            yield place, source, event
