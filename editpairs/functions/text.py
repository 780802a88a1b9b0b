"""Prompt functions. All run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that decide which rows are dropped or repeated.
PERSON_WORDS = ["man", "woman", "person", "people", "face", "boy", "girl", "child", "baby", "portrait", "selfie", "he", "she"]
KEEP_WORDS = ["keep", "same", "unchanged", "preserve", "maintain"]
GENERIC_PHRASES = [
    "make it better", "make this better", "enhance", "improve quality", "improve the quality",
    "make it look better", "make it nicer", "fix it", "correct it",
]
ACTION_VERBS = ["add", "remove", "replace", "change", "make", "turn", "give"]


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_prompt(prompt: Column) -> Column:
    """Stripped, case kept; null if nothing is left."""
    return F.nullif(strip(prompt), F.lit(""))


def _contains_any(text: Column, words: list[str]) -> Column:
    return F.coalesce(reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words)), F.lit(False))


def mentions_person(prompt: Column) -> Column:
    """Does a word for a person occur as a whole word, in any case?"""
    return F.coalesce(prompt.rlike(r"(?iU)\b(" + "|".join(PERSON_WORDS) + r")\b"), F.lit(False))


def keeps_intent(prompt: Column) -> Column:
    """Does the prompt ask to keep something (any part of a word counts)?"""
    return _contains_any(F.lower(prompt), KEEP_WORDS)


def is_generic(prompt: Column, max_words: int) -> Column:
    """A generic phrase, or at most max_words words and no verb of action; never for max_words 0; null is false."""
    if not max_words:
        return F.lit(False)
    text = strip(F.lower(prompt))
    short = (F.regexp_count(text, F.lit(r"(?U)\b[a-z]+\b")) <= max_words) & ~_contains_any(text, ACTION_VERBS)
    return F.coalesce(_contains_any(text, GENERIC_PHRASES) | short, F.lit(False))


def action(prompt: Column) -> Column:
    """remove, replace, change (change or make) or other, the first that occurs."""
    text = F.lower(prompt)
    return (
        F.when(F.contains(text, F.lit("remove")), "remove").when(F.contains(text, F.lit("replace")), "replace")
        .when(_contains_any(text, ["change", "make"]), "change").otherwise("other")
    )


def slug(prompt: Column) -> Column:
    """Words joined by underscores, lower case, 40 characters at most."""
    kept = F.lower(strip(F.regexp_replace(prompt, r"(?U)[^\w\s-]", "")))
    return F.left(F.regexp_replace(kept, r"(?U)[-\s]+", "_"), F.lit(40))


def output_name(timestamp: Column, prompt_id: Column, prompt: Column, seed: Column) -> Column:
    return F.concat(timestamp, F.lit("_"), prompt_id, F.lit("_"), slug(prompt), F.lit("_seed"), seed.cast("string"), F.lit(".png"))


def fixed_length(ids: Column, length: int, pad: int) -> Column:
    """Token ids cut or filled up to `length`."""
    ids = F.coalesce(ids, F.array().cast("array<int>"))
    return F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


#: Pieces between which a line may break: white space, runs of hyphens between words, words up to a hyphen that joins letters.
PIECES = (
    r"""(?U) +|(?<=[\w!"'&.,?])-{2,}(?=\w)"""
    r"""|[^ ]+?(?:-(?:(?<=[^\d\W]{2}-)|(?<=[^\d\W]-[^\d\W]-))(?=[^\d\W]-?[^\d\W])|(?= |\z)|(?<=[\w!"'&.,?])(?=-{2,}\w))"""
)


def shorten_caption(prompt: Column, width: int = 90, placeholder: str = "…") -> Column:
    """White space collapsed, and what is longer than `width` cut behind a piece, with an ellipsis in the room that is left."""
    text = strip(F.regexp_replace(prompt, r"(?U)[\s\x1c-\x1f]+", " "))
    room = width - len(placeholder)
    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))

    def fold(state: Column, piece: Column) -> Column:
        before, size = state["n"], F.length(piece)
        after = before + size
        # a piece that no line can hold is cut behind its last hyphen that fits
        head = F.left(piece, width - before)
        cut = F.regexp_extract(head, r"(?s)^(.*[^-].*-)", 1)
        inside = F.when((size > width) & (before <= width) & (cut != "") & (before + F.length(cut) <= room), before + F.length(cut))
        best = F.when((after <= room) & (piece != "") & ~F.startswith(piece, F.lit(" ")), after).otherwise(F.coalesce(inside, state["best"]))
        return F.struct(after.alias("n"), best.alias("best"))

    found = F.aggregate(pieces, F.struct(F.lit(0).alias("n"), F.lit(0).alias("best")), fold)
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.left(text, found["best"]), F.lit(placeholder)))
