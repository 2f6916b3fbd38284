"""Organisation and personal names: matching keys and display titles, without UDFs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _word_map(words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def match_key(name: Column | str) -> Column:
    """Name as a join key: upper case, no punctuation, abbreviations spelled out, leading fillers dropped."""
    text = F.upper(_col(name))
    for pattern, replacement in (
        ("&", " AND "),
        ("-", " "),
        (r"\bU\.S\.\s*", "US "),
        (r"[.,'()*]", ""),
        (r"\bU S\b", "US"),
    ):
        text = F.regexp_replace(text, pattern, replacement)
    spelled = _word_map(fixed.NAME_ABBREVIATIONS)
    words = F.transform(F.split(_squeeze(text), " "), lambda w: F.coalesce(F.try_element_at(spelled, w), w))
    key = F.array_join(words, " ")
    for prefix in fixed.NAME_PREFIXES:
        key = F.regexp_replace(key, "^" + prefix, "")
    return F.trim(key)


def _without_parentheses(name: Column) -> Column:
    return F.regexp_replace(name, r"\s*\([^)]*\)", "")


def unit_key(name: Column | str, fillers: str = fixed.ROSTER_FILLERS) -> Column:
    """Match key of a unit below an agency: parentheticals and filler words removed as well."""
    base = match_key(_without_parentheses(F.coalesce(_col(name), F.lit(""))))
    return _squeeze(F.regexp_replace(base, fillers, " "))


def footnoted_key(name: Column | str) -> Column:
    """Match key of a name that may end in footnote digits."""
    bare = F.trim(_without_parentheses(_col(name)))
    return match_key(F.trim(F.regexp_replace(bare, r"\d+$", "")))


def item_key(text: Column | str) -> Column:
    """Survey item as a key: smart punctuation folded, blanks squeezed, lower case, closing marks dropped."""
    plain = F.translate(_col(text), fixed.SMART_FROM, fixed.SMART_TO)
    return F.regexp_replace(F.lower(_squeeze(plain)), r"[?. ]+$", "")


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))


def title(name: Column | str) -> Column:
    """Display title: acronyms in capitals, abbreviations expanded, small words lower except the first."""
    spelled = _word_map(
        {**{w: w.upper() for w in fixed.TITLE_ACRONYMS},
         **{w: t for w, t in fixed.TITLE_ABBREVIATIONS.items() if w not in fixed.TITLE_ACRONYMS}}
    )

    def part(word: Column) -> Column:
        return F.coalesce(F.try_element_at(spelled, word), _capital(word))

    def one(word: Column, position: Column) -> Column:
        small = (position > 0) & word.isin(*fixed.TITLE_SMALL_WORDS)
        return F.when(small, word).otherwise(F.array_join(F.transform(F.split(word, "-"), part), "-"))

    return F.array_join(F.transform(F.split(_squeeze(F.lower(_col(name))), " "), one), " ")


def person_name(name: Column | str) -> Column:
    """Personal name for display; a name already in mixed case is left as written."""
    name = _col(name)

    def after(word: Column, lead: int) -> Column:
        head, rest = F.substring(word, 1, lead), F.substring(word, F.lit(lead + 1), F.length(word))
        return F.concat(_capital(head), _capital(rest))

    def one(word: Column, position: Column) -> Column:
        cased = (
            F.when(word.rlike("^mc[a-z]"), after(word, 2))
            .when(word.rlike("^mac[a-z]{3}"), after(word, 3))
            .when(word.rlike("^o'[a-z]"), after(word, 2))
            .otherwise(word)
        )
        pieces = F.array_join(F.transform(F.split(cased, "-"), _capital), "-")
        return F.when((position > 0) & word.isin(*fixed.SURNAME_PARTICLES), word).otherwise(pieces)

    proper = F.array_join(F.transform(F.split(_squeeze(F.lower(name)), " "), one), " ")
    mixed = (name != F.upper(name)) & (name != F.lower(name))
    return F.when(mixed, name).otherwise(proper)


def contains_any(name: Column, hints: dict[str, str]) -> Column:
    """Value of the first hint found inside the name."""
    tests = [F.when(name.contains(hint), F.lit(value)) for hint, value in hints.items()]
    return reduce(lambda a, b: F.coalesce(a, b), tests, F.lit(None).cast("string"))
