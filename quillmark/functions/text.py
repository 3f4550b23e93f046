"""Text expressions. All of them stay inside the JVM."""

import re
from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.fixed import NUMBER, PRE_TOKEN, PROMPT_TOKENS, WHITE_SPACE

WORD = r"[\p{L}\p{N}]+"


def strip(text: Column) -> Column:
    """Without white space, line breaks included, at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE_SPACE))


def remove(text: Column, part: str) -> Column:
    return F.replace(text, F.lit(part), F.lit(""))


def fill(template: str, **columns: Column) -> Column:
    """The template with each ``{name}`` replaced by that column."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [columns[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p]
    return F.concat(*pieces)


def whole_or_decimal(number: Column) -> Column:
    """3.0 as '3', 2.5 as '2.5'."""
    return F.when(
        number == F.floor(number), F.floor(number).cast("string")
    ).otherwise(number.cast("string"))


def first_number(text: Column) -> Column:
    """First integer or decimal in the text as a double; null if there is none."""
    found = F.nullif(F.regexp_extract(text, NUMBER, 0), F.lit(""))
    return found.try_cast("double")


def after_echo(text: Column, prompt: Column) -> Column:
    """Reply without the prompt in front; the whole text if it is not echoed."""
    at = F.position(prompt, text)
    rest = F.substring(text, at + F.length(prompt), F.length(text))
    return strip(F.when(at > 0, rest).otherwise(text))


def to_last_full_stop(text: Column) -> Column:
    """Cut behind the last full stop; add one if there is none."""
    tail = F.position(F.lit("."), F.reverse(text))
    cut = F.substring(text, F.lit(1), F.length(text) - tail + 1)
    return F.when(tail > 0, cut).otherwise(F.concat(rstrip(text), F.lit(".")))


def _first_tokens(text: Column, count: Column, most: int) -> Column:
    """First ``count`` pre-tokens of the text, at most ``most``.

    One match from the beginning that ends with the last of them, so what is behind
    is never looked at. Pre-tokens cover every character, so there is always a next
    one until the text ends. They are counted in groups, each matched for good, so
    that the matcher's stack holds no more than a group of them.
    """
    group = isqrt(most) + 1
    token = f"(?:{PRE_TOKEN})"
    times = lambda n: F.concat(F.lit("{0,"), n.cast("string"), F.lit("}"))
    groups, rest = F.floor(count / group), F.pmod(count, F.lit(group))
    pattern = F.concat(F.lit(f"^(?>(?>{token}{{0,{group}}})"), times(groups), F.lit(f")(?>{token}"), times(rest), F.lit(")"))
    return F.call_function("regexp_extract", text, pattern, F.lit(0))


def truncate_tokens(text: Column, budget: int = PROMPT_TOKENS, keep_suffix: str = "") -> Column:
    """First ``budget`` pre-tokens of the text, in time that does not depend on what follows.

    With ``keep_suffix`` a text that is cut still ends with it.
    """
    head = _first_tokens(text, F.lit(budget), budget)
    if not keep_suffix:
        return head
    suffix = F.lit(" " + keep_suffix)
    room = F.greatest(F.lit(budget) - F.size(F.regexp_extract_all(suffix, F.lit(PRE_TOKEN), F.lit(0))), F.lit(0))
    cut = F.concat(_first_tokens(text, room, budget), suffix)
    return F.when(F.octet_length(head) == F.octet_length(text), text).otherwise(cut)


def words(text: Column) -> Column:
    """Sorted lower-case words of the text, repeats included."""
    return F.sort_array(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))
