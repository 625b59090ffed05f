"""Which form templates can match a text, found by the fixed parts of their patterns.

A pattern of a template is fixed text between open runs. Every fixed part is
searched in a text at once, by one automaton over all parts of all templates;
a template is met through its rarest part and then must have all of them. What
is left, few templates of very many, is matched as a pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

#: A pattern as tokens: open runs, an escaped sign, a plain character, or anything else.
_TOKEN = re.compile(r"(?P<open>\(\.[+*]\??\)|\.[+*]\??)|\\(?P<sign>[^0-9A-Za-z])|(?P<plain>[^.^$*+?{}\[\]\\|()])|(?P<other>.)", re.DOTALL)


#: Texts of a batch that are Python strings at the same time.
SLICE = 256


def fixed_parts(pattern: str) -> list[str]:
    """Texts that every match of a pattern holds; none where the pattern is more than fixed text and open runs."""
    body = pattern.removeprefix("^")
    body = body[:-1] if body.endswith("$") and not body.endswith("\\$") else body
    parts, part = [], ""
    for m in _TOKEN.finditer(body):
        if m["other"] is not None:
            return []
        if m["open"] is not None:
            parts.append(part)
            part = ""
        else:
            part += m["sign"] or m["plain"]
    return sorted({p for p in [*parts, part] if p})


class Index:
    """Templates by their rarest fixed part; numbers are places in the list of patterns."""

    def __init__(self, patterns: Sequence[str]):
        parts = [fixed_parts(p) for p in patterns]
        often: dict[str, int] = {}
        for held in parts:
            for p in held:
                often[p] = often.get(p, 0) + 1
        self.open = [i for i, held in enumerate(parts) if not held]
        self.needs = [frozenset(held) for held in parts]
        self.by_part: dict[str, list[int]] = {}
        for i, held in enumerate(parts):
            if held:
                self.by_part.setdefault(min(held, key=lambda p: (often[p], -len(p), p)), []).append(i)
        self.parts = sorted(often)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.parts:
            return None
        made = ahocorasick.Automaton()
        for p in self.parts:
            made.add_word(p, p)
        made.make_automaton()
        return made

    def candidates(self, text: str | None, automaton) -> list[int]:
        """Numbers of the templates that may match, in order."""
        if text is None:
            return []
        found = {p for _, p in automaton.iter(text)} if automaton is not None else set()
        met = [i for p in found if p in self.by_part for i in self.by_part[p] if self.needs[i] <= found]
        return sorted([*met, *self.open])


def candidates(text: Column, index: Index) -> Column:
    """Numbers of the templates that may match a text; the automaton is made once per task.

    The texts stay in their Arrow batch but for a slice of them, so a task holds them once.
    """

    @arrow_udf("array<int>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = index.automaton()
        for texts in batches:
            slices = (texts.slice(at, SLICE).to_pylist() for at in range(0, len(texts), SLICE))
            yield pa.array((index.candidates(t, made) for some in slices for t in some), pa.list_(pa.int32()))

    return find(text)


def ordered(templates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row, one array: the templates, longest pattern first, then lowest id. People write them, so it is small."""
    held = F.struct((-F.length("regex")).alias("size"), "template_id", "regex", *keys)
    return templates.where(F.col("regex").isNotNull()).agg(F.array_sort(F.collect_list(held)).alias("all"))
