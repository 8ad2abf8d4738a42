"""Text classifiers as ordered column rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: cue words; the negative list is tried first.
NEGATIVE = ("loss", "losses", "decline", "drop", "fall", "falls", "plunge", "downgrade", "lawsuit", "fraud", "default", "warning")
POSITIVE = ("profit", "growth", "surge", "rise", "rises", "upgrade", "record", "gain", "gains", "expansion", "dividend")
EVENT_WORDS = (("DIVIDEND", ("dividend", "coupon", "توزيع")), ("SPLIT", ("split", "تجزئة")), ("EARNINGS", ("earnings", "results", "profit", "أرباح")), ("MERGER", ("merger", "acquisition", "استحواذ")), ("CAPITAL_INCREASE", ("capital increase", "rights issue", "زيادة رأس")))
STOP = ("the", "and", "for", "of", "co", "company", "sae", "holding", "group", "inc", "ltd", "plc", "egypt", "egyptian")


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def sentiment(text: Column) -> Column:
    low = F.lower(text)
    return F.when(_any(low, NEGATIVE), "negative").when(_any(low, POSITIVE), "positive").otherwise("neutral")


def event_type(text: Column) -> Column:
    low, out = F.lower(text), F.lit("OTHER")
    for name, words in reversed(EVENT_WORDS):
        out = F.when(_any(low, words), name).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Lower-case words without stop words, in order, once each."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_except(F.array_remove(words, ""), F.array(*map(F.lit, STOP)))


def names_all(name_tokens: Column, text_tokens: Column) -> Column:
    """Whether every word of a name occurs in a text."""
    return (F.size(name_tokens) > 0) & (F.size(F.array_except(name_tokens, text_tokens)) == 0)
