"""Which hand-written patterns may run, judged by the engine that runs them.

A pattern may run if it is built from what every regular-expression dialect reads alike: literal characters, `.`, the
anchors `^` and `$`, escapes of classes and punctuation, character classes without nesting or intersection, alternatives, groups
and `(?:` groups three deep, and greedy or lazy counts. A group with an open count or an alternative inside may itself only
be optional, and at most three `.*` or `.+` may stand in a pattern, so no pattern backtracks without bound. The rule is one constant pattern
itself, which is compiled once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LENGTH, MAX_OPEN_DOTS = 500, 3

_ESCAPE = r"\\(?:[dDwWsSbBtnr]|[^\w\s])"
_IN_CLASS = r"(?:\\(?:[dDwWsStnr]|[^\w\s])|[^\\\[\]\-&^])"
_CLASS = rf"\[\^?-?(?:\w-\w(?!-(?!\]))|{_IN_CLASS}(?!-(?!\])))+-?\]"
_ATOM = rf"(?:{_ESCAPE}|{_CLASS}|[^\\\[\](){{}}*+?|^$])"
_COUNT = r"(?:[*+?]|\{\d{1,3}(?:,\d{0,3})?\})\??"
_OPTION = r"\??\??"
_ANCHOR = r"[\^$]"
_OPEN = r"\((?:\?:)?"
#: A group without alternatives, where only fixed counts stand, may repeat; any other one may only be optional.
_SIMPLE = rf"{_OPEN}(?:{_ATOM}(?:\{{[1-9]\d{{0,2}}\}})?|{_ANCHOR})*+\)"
_INNER = rf"(?:{_ATOM}(?:{_COUNT})?|{_ANCHOR}|{_SIMPLE}(?:{_COUNT})?|\|)"
_MIDDLE = rf"(?:{_INNER}|{_OPEN}{_INNER}*+\){_OPTION})"
_OUTER = rf"(?:{_MIDDLE}|{_OPEN}{_MIDDLE}*+\){_OPTION})"
PLAIN = rf"^{_OUTER}*+$"


def may_run(pattern: Column) -> Column:
    """Whether a pattern may run; true of no pattern."""
    text = F.coalesce(pattern, F.lit(""))
    unescaped = F.regexp_replace(text, r"\\.", "")
    bare = F.regexp_replace(unescaped, r"\[[^\]]*\]", "")
    open_dots = F.size(F.split(bare, r"\.(?:[*+]|\{\d+,\})")) - 1
    # a range is written upwards: [z-a] is an error in every dialect
    ranges = F.regexp_extract_all(unescaped, F.lit(r"(\w-\w)"), F.lit(1))
    upward = F.forall(ranges, lambda r: F.substring(r, 1, 1) <= F.substring(r, 3, 1))
    classes = F.array_join(F.regexp_extract_all(unescaped, F.lit(r"(\[[^\]]*\])"), F.lit(1)), "")
    sound = F.when(F.contains(classes, F.lit("-")), upward).otherwise(F.lit(True))
    counts = F.regexp_extract_all(bare, F.lit(r"\{(\d+,\d+)\}"), F.lit(1))
    ordered = F.forall(counts, lambda c: F.split(c, ",")[0].cast("int") <= F.split(c, ",")[1].cast("int"))
    return (F.length(text) <= MAX_LENGTH) & F.rlike(text, F.lit(PLAIN)) & (open_dots <= MAX_OPEN_DOTS) & sound & ordered
