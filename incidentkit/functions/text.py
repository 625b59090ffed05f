"""Ticket text as Column expressions: cleaning, tokens, extraction.

Everything here is a built-in expression, so it stays in the JVM and sees the
whole text. Patterns carry ``(?d)`` where a dot must stop only at a newline.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Header line that the service desk tool puts before each entry.
ENTRY_HEADER = r"^\d\d-\d\d-\d\d\d\d\s\d\d:\d\d .+?, .+?:"

# Order of extraction patterns for request texts, capture group 1.
REQUEST_PATTERNS = (
    r"[\s\S]*omschrijving[\s\S]*storing:([\s\S]*)volledige[\s]*naam:[\s\S]*",
    r"[\s\S]*omschrijving[\s\S]*storing:([\s\S]*)telefoonnummer[\s\S]*cijferige\):[\s\S]*",
    r"[\s\S]*omschrijving[\s\S]*probleem:([\s\S]*)volledige[\s\S]*",
    r"^([\s\S]*)volledige[\s\S]*naam:[\s\S]*",
    r"[\s\S]*mailt:([\s\S]*)",
)

# The longer pattern list for tickets and problems, capture group 2.
PROBLEM_PATTERNS = (
    r"[\s\S]*omschrijving[\s\S]*?(probleem|storing|foutmelding)[\s]*:([\s\S]*)inlognaam[\s]*[bas]*[\s]*:",
    r"[\s\S]*omschrijving[\s\S]*?(probleem|storing|foutmelding)[\s]*?:([\s\S]*)e[-]*?mail[\s\S]*:",
    r"[\s\S]*omschrijving[\s\S]*?(probleem|storing|foutmelding)[\s]*:([\s\S]*)volledige[\s]*naam[\s]*:",
    r"[\s\S]*omschrijving[\s\S]*?(probleem|storing|foutmelding)[\s]*:([\s\S]*)\(graag volledige, 10-cijferige\)[\s]*:",
    r"[\s\S]*omschrijving[\s\S]*?(probleem|storing|foutmelding)[\s]*:([\s\S]*)applicatie[\s]*:",
    r"[\s\S]*omschrijving[\s\S]*?(probleem|storing|foutmelding)[\s]*:([\s\S]*)telefoonnummer[\s\S]*:",
    r"[\s\S]*omschrijving[\s\S]*?(vraag)[\s]*:([\s\S]*)",
    r"[\s\S]*(vraag)[\s\S]*:([\s\S]*)antwoord[\s\S]*",
)

# Word that marks the line of a template that holds the description.
DESCRIPTION_WORD = "omschrijving"

_LINE_BREAK = r"\r\n|\n|\r"


def capture(c: Column, pattern: Column, group: int = 1) -> Column:
    """``regexp_extract`` with a pattern that is itself a column."""
    return F.call_function("regexp_extract", c, pattern, F.lit(group))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_controls(c: Column, tilde: bool = False, quotes: bool = False) -> Column:
    """``' :'`` to ``':'``; line ends and tabs to blanks; optionally ``~`` and quotes too."""
    out = F.translate(F.replace(c, F.lit(" :"), F.lit(":")), "\n\r\t", "   ")
    if tilde:
        out = F.translate(out, "~", " ")
    if quotes:
        out = F.replace(F.replace(out, F.lit("  "), F.lit(" ")), F.lit('"'))
    return out


def strip_entry_header(c: Column) -> Column:
    """Drop a leading ``dd-mm-yyyy hh:mm name, part:`` and trim."""
    return strip(F.regexp_replace(c, "(?d)" + ENTRY_HEADER, ""))


# What each mode removes, and what it puts in its place.
_PUNCTUATION = {
    "marks": (r"[?:!.,;]", ""),
    "non_word": (r"(?U)[^\w\s]", ""),
    "letters": (r"[^a-z]+", " "),
    "ascii_non_word": (r"[^\w\s]", ""),
    "separators": (r"[,\-./]", ""),
}


def strip_punct(c: Column, mode: str = "non_word") -> Column:
    """``marks``, ``non_word``, ``letters`` (keep a-z only) or ``separators`` (``, - . /``)."""
    pattern, put = _PUNCTUATION[mode]
    return F.regexp_replace(c, pattern, put)


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, r"http\S+", "")


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition, kept to ASCII, of every character that has one."""
    single_from, single_to, longer = [], [], {}
    for code in range(0x80, 0x20000):
        if 0xAC00 <= code <= 0xDFFF:
            continue
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode("ascii")
        if len(plain) == 1:
            single_from.append(char)
            single_to.append(plain)
        elif plain:
            longer[char] = plain
    return "".join(single_from), "".join(single_to), longer


def ascii_fold(c: Column) -> Column:
    """Base letters of accented characters; whatever has no ASCII form is dropped."""
    old, new, longer = _fold_tables()
    forms = F.create_map(*[F.lit(x) for pair in longer.items() for x in pair])
    single = F.translate(c, old, new)
    # What is still outside ASCII has a longer form or none; few texts get here.
    chars = F.transform(
        F.split(single, ""), lambda ch: F.when(ch > "\x7f", forms[ch]).otherwise(ch)
    )
    rest = F.array_join(F.array_compact(chars), "")
    outside = r"[^\x00-\x7F]"
    return F.when(~c.rlike(outside), c).when(~single.rlike(outside), single).otherwise(rest)


def tokenize(c: Column, pattern: str = r"\S+") -> Column:
    r"""All matches of a pattern: ``\S+`` by blanks, ``\w{1,}`` words, ``\w{2,}`` longer words."""
    return F.regexp_extract_all(c, F.lit("(?U)" + pattern), F.lit(0))


def drop_numbers(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.rlike(r"^\d+$"))


def _word_array(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def remove_stopwords(tokens: Column, words: Sequence[str] | Column, min_len: int = 3) -> Column:
    """Drop stop words and words shorter than ``min_len``."""
    if isinstance(words, Column):
        listed = lambda t: F.array_contains(words, t)
    else:
        listed = lambda t: t.isin(*words) if words else F.lit(False)
    return F.filter(tokens, lambda t: (F.length(t) >= min_len) & ~listed(t))


def replace_words(
    tokens: Column, replacements: Mapping[str, str], stopwords: Sequence[str] = ()
) -> Column:
    """A mapped word is followed in by its replacement and stays itself unless a stop word."""
    lowered = F.transform(tokens, lambda t: F.lower(t))
    kept = lambda t: F.when(~t.isin(*stopwords), t) if stopwords else t
    if not replacements:
        return F.array_compact(F.transform(lowered, kept))
    table = F.create_map(*[F.lit(x) for pair in replacements.items() for x in pair])
    # A hashed test of all words, and a scan of the map for the few that it holds.
    mapped = lambda t: F.when(t.isin(*replacements), table[t])
    return F.array_compact(F.flatten(F.transform(lowered, lambda t: F.array(mapped(t), kept(t)))))


def normalize(
    c: Column, stopwords: Sequence[str] = (), replacements: Mapping[str, str] | None = None
) -> Column:
    """Tokens after folding, lower case, punctuation, numbers, replacements and stop words."""
    clean = strip_punct(F.lower(ascii_fold(strip_urls(c))), "ascii_non_word")
    tokens = F.regexp_extract_all(clean, F.lit(r"\S+"), F.lit(0))
    return replace_words(drop_numbers(tokens), replacements or {}, stopwords)


def _let(value: Column, body) -> Column:
    """Bind a value once: inside a lambda a plain expression would be evaluated per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(items: Column, n: int, sep: str) -> Column:
    """Every n consecutive items, joined: n shifted copies of the array side by side."""
    if n == 1:
        return items
    count = F.greatest(F.size(items) - (n - 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice(items, i + 1, count).alias(f"g{i}") for i in range(n)])
    return F.transform(shifted, lambda g: F.concat_ws(sep, *[g[f"g{i}"] for i in range(n)]))


def word_ngrams(tokens: Column, low: int, high: int) -> Column:
    """Runs of low..high tokens joined by a blank."""
    return _let(tokens, lambda t: F.concat(*[_runs(t, n, " ") for n in range(low, high + 1)]))


def char_ngrams(c: Column, low: int, high: int) -> Column:
    """Runs of low..high characters."""
    # A match takes one character and captures the run that begins with it.
    return F.concat(*[F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)) for n in range(low, high + 1)])


def anchored(pattern: str) -> str:
    r"""Pin a pattern that opens with ``[\s\S]*`` to the start of the text.

    It matches the same texts with the same captures, but a text without a
    match is given up after one attempt instead of one per position. The class
    of all characters is written as a dot over all characters, which the
    matcher repeats without a step per character.
    """
    every = r"[\s\S]"
    body = pattern.replace(every, "(?s:.)")
    return r"\A" + body if pattern.startswith(every + "*") else body


def extract_first(c: Column, patterns: Sequence[str], group: int = 1) -> Column:
    """Trimmed capture of the first pattern that matches the lower-cased text, else null."""
    text = F.lower(c)
    return F.coalesce(*[_first_capture(text, F.lit("(?d)" + anchored(p)), group) for p in patterns])


def _first_capture(text: Column, pattern: Column, group: int) -> Column:
    """Trimmed capture, null without a match; one pass, and an empty capture counts as a match."""
    return strip(F.get(F.call_function("regexp_extract_all", text, pattern, F.lit(group)), F.lit(0)))


def extract_cascade(
    c: Column, patterns: Sequence[str] = REQUEST_PATTERNS, group: int = 1
) -> Column:
    """Each pattern that matches narrows the text to its capture; no match changes nothing.

    With one capture group an empty capture is a result. With more groups only
    a capture that is not empty, before it is trimmed, counts; where the trim
    leaves nothing, the next pattern starts again from the whole text. The
    chain is a fold over the pattern list, so the expression grows by one step
    per pattern.
    """
    steps = F.array(*[F.lit(anchored(p)) for p in patterns])
    if group == 1:
        return F.aggregate(steps, c, lambda text, pattern: F.coalesce(_first_capture(F.lower(text), pattern, group), text))

    def narrow(rest: Column, pattern: Column) -> Column:
        def step(text: Column) -> Column:
            raw = F.get(F.call_function("regexp_extract_all", F.lower(text), pattern, F.lit(group)), F.lit(0))
            return _let(raw, lambda found: F.when(found != "", strip(found)).otherwise(text))

        return _let(F.when(rest != "", rest).otherwise(c), step)

    return F.aggregate(steps, c, narrow)


def template_lines(c: Column) -> Column:
    """Lines of a template without the yes/no choice text."""
    return F.split(F.replace(c, F.lit("Ja/Nee")), _LINE_BREAK)


def template_to_regex(c: Column) -> Column:
    """Pattern of a form template with one capture group for the description.

    The first line that speaks of a description is followed by the capture;
    every other filled line by anything. Without such a line the capture leads.
    """
    special = r"([()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0b\f])"
    marks = F.transform(
        template_lines(c), lambda x: F.contains(F.lower(x), F.lit(DESCRIPTION_WORD))
    )

    def body(hit: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            text = F.regexp_replace(F.lower(strip(x)), special, r"\\$1")
            return (
                F.when(i + 1 == hit, F.concat(text, F.lit("(.+?)")))
                .when(text != "", F.concat(text, F.lit(".*?")))
                .otherwise(F.lit(""))
            )

        lead = F.when(hit == 0, F.lit("(.+?)")).otherwise(F.lit(""))
        return F.concat(F.lit("^"), lead, F.array_join(F.transform(template_lines(c), part), ""), F.lit("$"))

    return _let(F.array_position(marks, True), body)


def text_stats(c: Column) -> dict[str, Column]:
    """Length, word count, density and counts of punctuation, title and upper-case words."""
    words = tokenize(c)
    n = F.size(words)
    return {
        "char_count": F.length(c),
        "word_count": n,
        "word_density": F.length(c) / (n + 1),
        "punctuation_count": F.regexp_count(c, F.lit(r"[!-/:-@\[-`{-~]")),
        "title_word_count": F.size(F.filter(words, lambda w: w.rlike(r"^[A-Z][^A-Z]*$"))),
        "upper_case_word_count": F.size(F.filter(words, lambda w: w.rlike(r"^[^a-z]*[A-Z][^a-z]*$"))),
    }


def contains_flags(tokens: Column, words: Sequence[str]) -> Column:
    """Map word to true for the listed words that occur in the tokens."""
    found = F.array_intersect(_word_array(words), tokens)
    return F.map_from_entries(F.transform(found, lambda w: F.struct(w, F.lit(True))))


def name_parts(c: Column) -> dict[str, Column]:
    """Group (first two words), whether the second word opens with a quote, whether a cultivar."""
    words = F.split(F.trim(c), r"\s+")
    second = F.get(words, F.lit(1))
    return {
        "group_name": F.array_join(F.slice(words, 1, 2), " "),
        "is_exception": F.coalesce(F.startswith(second, F.lit("'")), F.lit(False)),
        "is_cultivar": F.size(words) >= 3,
    }


def sign_and_abs(c: Column) -> dict[str, Column]:
    """Signed balance as positive units with factor 1 or -1."""
    return {"units": F.abs(c), "factor": F.when(c < 0, -1).otherwise(1)}
