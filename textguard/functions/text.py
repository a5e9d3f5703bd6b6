"""Text functions as native column expressions (no Python per row except Unicode folding)."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textguard.functions import patterns as P


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _count(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(_col(c), F.lit(pattern)).cast("int")


def strip_spaces(c: Column | str) -> Column:
    """Trim all Unicode white space (``trim`` alone removes only U+0020)."""
    return F.btrim(_col(c), F.lit(P.WS_CHARS))


def count_words(c: Column | str) -> Column:
    """White-space pieces: one more than the runs of white space inside the trimmed text."""
    t = strip_spaces(c)
    return F.when(t == "", 0).otherwise(_count(t, P.SPACE_RUN) + 1).cast("int")


def has_more_words(c: Column | str, n: int) -> Column:
    """``count_words(c) > n`` without reading past the first ``n + 1`` words."""
    run = f"(?:{P.NON_WS}++{P.SPACES}+){{{n}}}{P.NON_WS}"
    return _col(c).rlike(run)


def count_characters(c: Column | str) -> Column:
    return F.length(_col(c)).cast("int")


def count_mentions(c: Column | str) -> Column:
    return _count(c, P.MENTION)


def count_hashtags(c: Column | str) -> Column:
    return _count(c, P.HASHTAG)


def count_urls(c: Column | str) -> Column:
    """Case-sensitive scheme, as opposed to the any-case removal of :func:`clean_light`."""
    return _count(c, P.URL)


def count_capitals(c: Column | str) -> Column:
    """ASCII capitals; the length difference avoids building an array of single letters."""
    c = _col(c)
    return (F.length(c) - F.length(F.regexp_replace(c, P.CAPITAL, ""))).cast("int")


TEXT_STATS = {
    "words": count_words,
    "chars": count_characters,
    "mentions": count_mentions,
    "hashtags": count_hashtags,
    "urls": count_urls,
    "capitals": count_capitals,
}


def text_stats(column: str) -> list[Column]:
    """The six statistics of ``column``, named ``{column}_{statistic}``."""
    return [fn(column).alias(f"{column}_{name}") for name, fn in TEXT_STATS.items()]


def strip_emoji(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), P.EMOJI, "")


def squeeze_spaces(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(c), P.SPACES, " "), "^ | $", "")


def clean_text(
    c: Column | str,
    *,
    handle_emoji: bool = True,
    keep_mentions_hashtags: bool = False,
    fix_unicode: bool = False,
) -> Column:
    """Aggressive cleaning before vectorisation; the order of the steps is part of the meaning.

    With ``keep_mentions_hashtags`` a mention becomes the token ``user`` and a hashtag the token
    ``hashtag`` (their symbols are blanked later). Emoji are removed, not described: that is the
    documented intent, and what happens where no emoji dictionary is installed.
    """
    t = normalize_nfkc(c) if fix_unicode else _col(c)
    t = F.regexp_replace(t, P.TAG, "")
    t = F.regexp_replace(t, P.URL, "")
    t = F.regexp_replace(t, P.MENTION, " @USER " if keep_mentions_hashtags else "")
    t = F.regexp_replace(t, P.HASHTAG, " #HASHTAG " if keep_mentions_hashtags else "")
    if handle_emoji:
        t = strip_emoji(t)
    t = F.regexp_replace(t, P.RETWEET, "")
    # blanking everything but letters and digits and squeezing the result is one replacement
    return F.trim(F.lower(F.regexp_replace(t, P.SEPARATOR_RUN, " ")))


def clean_light(
    c: Column | str,
    *,
    fix_unicode: bool = False,
    remove_urls: bool = False,
    remove_mentions: bool = False,
    remove_hashtags: bool = False,
    lowercase: bool = False,
    remove_extra_whitespace: bool = True,
) -> Column:
    """Flag-driven cleaning of the validation step. Handles are word characters only here."""
    t = normalize_nfkc(c) if fix_unicode else _col(c)
    if remove_urls:
        t = F.regexp_replace(t, P.URL_ANY_CASE, "")
    if remove_mentions:
        t = F.regexp_replace(t, P.MENTION_WORD, "")
    if remove_hashtags:
        t = F.regexp_replace(t, P.HASHTAG_WORD, "")
    if lowercase:
        t = F.lower(t)
    if remove_extra_whitespace:
        t = squeeze_spaces(t)
    return t


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def normalize_nfkc(c: Column | str) -> Column:
    """NFKC form. ASCII text is its own NFKC form, so only other rows travel to Python."""
    c = _col(c)
    return F.coalesce(_nfkc(F.when(~c.rlike(P.ASCII_ONLY), c)), c)


def tokenize(c: Column | str, *, stop_words: Sequence[str] = (), min_chars: int = 2) -> Column:
    """Lower-case word tokens of at least ``min_chars`` characters, stop words removed."""
    pattern = P.TOKEN_1PLUS if min_chars <= 1 else P.WORD_CHAR + "{%d,}" % min_chars
    tokens = F.regexp_extract_all(F.lower(_col(c)), F.lit(pattern), F.lit(0))
    if not stop_words:
        return tokens
    # isin over literals compiles to a hash set; array_contains would scan the list per token
    return F.filter(tokens, lambda t: ~t.isin(*stop_words))


def split_words(c: Column | str, *, lowercase: bool = False) -> Column:
    """White-space pieces, as used for word vectors (lower-cased for lookup only)."""
    t = strip_spaces(F.lower(_col(c)) if lowercase else c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, P.SPACE_RUN))


def ngrams(tokens: Column, n: int) -> Column:
    """Adjacent tokens joined by a space; built by zipping slices, never by indexing."""
    if n == 1:
        return tokens
    size = F.size(tokens)
    length = F.greatest(size - F.lit(n - 1), F.lit(0))
    out = F.slice(tokens, F.lit(1), length)
    for shift in range(1, n):
        out = F.zip_with(out, F.slice(tokens, F.lit(shift + 1), length), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def ngram_range(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams with ``low <= n <= high`` in one array."""
    parts = [ngrams(tokens, n) for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def highlight_words(text: Column | str, explanation: Column | str) -> Column:
    """HTML with influential words marked: red for a positive weight, green otherwise.

    ``explanation`` is ``array<struct<word,weight>>``; opacity is ``min(255, int(|w| * 500)) / 255``.
    """
    explanation = _col(explanation)

    def mark(word: Column) -> Column:
        bare = F.btrim(F.lower(word), F.lit(".,!?;:()[]{}\"'-"))
        weight = F.try_element_at(F.filter(explanation, lambda e: e["word"] == bare), F.lit(-1))["weight"]
        level = F.least(F.lit(255), F.floor(F.abs(weight) * 500)).cast("double") / 255
        colour = F.when(weight > 0, "255, 0, 0").otherwise("0, 255, 0")
        return F.when(weight.isNull(), word).otherwise(
            F.concat(
                F.lit('<span style="background-color: rgba('),
                colour,
                F.lit(", "),
                F.format_string("%.2f", level),
                F.lit('); padding: 2px 4px; border-radius: 3px;">'),
                word,
                F.lit("</span>"),
            )
        )

    return F.array_join(F.transform(split_words(text), mark), " ")
