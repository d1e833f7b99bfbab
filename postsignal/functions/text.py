"""Text metrics (TXT-1 ... TXT-12) as JVM-side column expressions.

Every metric is a built-in Spark expression (``length``, ``regexp_count``,
higher-order ``aggregate``), so a whole family is one projection inside
whole-stage codegen; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Patterns that must equal the reference's definitions.
# Python's ``\w`` on str is "letter, number or underscore"; Java's (?U)\w also
# takes marks, so the class is spelled out to keep Python's meaning.
WORD_CHAR = r"[\p{L}\p{N}_]"
HASHTAG_PATTERN = r"#[\p{L}\p{N}_]+"
MENTION_PATTERN = r"@[\p{L}\p{N}_]+"
URL_PATTERN = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
ELONGATION_PATTERN = r"([\p{L}\p{N}_])\1{2,}"
EXCESS_PUNCT_PATTERN = r"[!?]{2,}"
NON_SPACE_RUN = r"(?U)\S+"
SPACE_CHAR = r"(?U)\s"
UPPERCASE_CHAR = r"\p{IsUppercase}"
VIDEO_PATTERN = r"(?i)(video|tweet_video|amplify_video|video_thumb)"
# Single code points with the Emoji property of the public Unicode data, beyond ASCII; regional
# indicators are emoji in pairs only and no part of it.
EMOJI_CODE_POINTS = """
A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0
25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653
265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE
26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716
271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07
2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F201-1F202 1F21A 1F22F
1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD
1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8
1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5
1F6CB-1F6D2 1F6D5-1F6D9 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945
1F947-1F9FF 1FA70-1FA7C 1FA80-1FAC6 1FAC8 1FACC-1FADD 1FADF-1FAEB 1FAEF-1FAFA
"""
# ---------------------------------------------------------------------------
EMOJI_CLASS = "[" + "".join("-".join(rf"\x{{{p}}}" for p in span.split("-")) for span in EMOJI_CODE_POINTS.split()) + "]"
# The same code points; the look-ahead passes over all others below U+203C and between
# U+3299 and U+1F004 with a few comparisons before the long list.
EMOJI_SCAN = r"(?=[\x{A9}\x{AE}\x{203C}-\x{3299}\x{1F004}-\x{1FAFF}])" + EMOJI_CLASS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c) -> Column:
    """``x or ""`` for a nullable string column (TXT-1 input)."""
    return F.coalesce(_c(c), F.lit(""))


def combined_text(text="text", quoted="quoted_text") -> Column:
    """TXT-1: ``text + " " + quoted`` with nulls as empty strings."""
    return F.concat(text_or_empty(text), F.lit(" "), text_or_empty(quoted))


def count_matches(c, pattern: str) -> Column:
    """Number of non-overlapping matches, as ``len(re.findall(...))``."""
    return F.regexp_count(_c(c), F.lit(pattern)).cast("long")


def count_where(gate: Column, c, pattern: str) -> Column:
    """``count_matches`` behind a cheap test that every match passes, so most texts skip the scan."""
    return F.when(gate, count_matches(c, pattern)).otherwise(F.lit(0).cast("long"))


def word_count(c) -> Column:
    """``len(s.split())`` on Unicode white space."""
    return count_matches(text_or_empty(c), NON_SPACE_RUN)


def mean_word_length(c) -> Column:
    """TXT-4: mean word length, 0 when the text has no words."""
    t = text_or_empty(c)
    words = count_matches(t, NON_SPACE_RUN)
    chars = F.length(t) - count_matches(t, SPACE_CHAR)   # non-space code points
    return F.when(words > 0, chars / words).otherwise(F.lit(0.0))


# ---- all counts of a text in one pass over bound texts

COMBINED, MAIN, QUOTED = "_combined_counts", "_main_counts", "_quoted_counts"


def bound(value: Column, build) -> Column:
    """``build(value)`` with the value worked out once, however often ``build`` uses it."""
    return F.transform(F.array(value), build)[0]


def count_columns(text="text", quoted="quoted_text") -> list[Column]:
    """The counts of the combined, main and quoted text as three structs: a lower projection from which
    ``counted_metric_columns`` takes the metrics, so that no text is put together or scanned twice for one pattern."""
    def combined(c: Column) -> Column:
        return F.struct(F.length(c).cast("long").alias("chars"), count_matches(c, HASHTAG_PATTERN).alias("hashtags"), count_matches(c, MENTION_PATTERN).alias("mentions"),
                        count_matches(c, URL_PATTERN).alias("urls"), count_matches(c, EMOJI_SCAN).alias("emojis"), count_matches(c, UPPERCASE_CHAR).alias("upper"),
                        count_matches(c, ELONGATION_PATTERN).alias("elongations"), count_matches(c, EXCESS_PUNCT_PATTERN).alias("excess"))

    def single(c: Column) -> Column:
        return F.struct(F.length(c).cast("long").alias("chars"), count_matches(c, NON_SPACE_RUN).alias("words"), count_matches(c, SPACE_CHAR).alias("spaces"))

    return [bound(combined_text(text, quoted), combined).alias(COMBINED), bound(text_or_empty(text), single).alias(MAIN), bound(text_or_empty(quoted), single).alias(QUOTED)]


def counted_metric_columns() -> list[Column]:
    """TXT-1 ... TXT-11 from the counts of ``count_columns``, named and typed as by the two functions below."""
    c, t, q = (lambda f, s=s: F.col(f"{s}.{f}") for s in (COMBINED, MAIN, QUOTED))

    def mean(x) -> Column:
        return F.when(x("words") > 0, (x("chars") - x("spaces")) / x("words")).otherwise(F.lit(0.0))

    kinds = ("hashtag", "mention", "url", "emoji")
    return [
        t("chars").alias("text_length"), q("chars").alias("quoted_text_length"), c("chars").alias("combined_text_length"),
        t("words").alias("text_word_count"), q("words").alias("quoted_text_word_count"), (t("words") + q("words")).alias("combined_word_count"),
        mean(t).alias("avg_word_length_text"), mean(q).alias("avg_word_length_quoted"),
        *[c(f"{k}s").alias(f"{k}_count") for k in kinds], *[(c(f"{k}s") / c("chars")).alias(f"{k}_density") for k in kinds],
        (c("upper") / c("chars")).alias("uppercase_ratio"), c("elongations").alias("word_elongation_count"), c("excess").alias("excessive_punctuation_count"),
    ]


def text_metric_columns(text="text", quoted="quoted_text") -> list[Column]:
    """TXT-1 ... TXT-8: the 16 basic text metrics."""
    t, q = text_or_empty(text), text_or_empty(quoted)
    c = combined_text(text, quoted)
    clen = F.length(c)
    n_hash = count_where(F.contains(c, F.lit("#")), c, HASHTAG_PATTERN)
    n_ment = count_where(F.contains(c, F.lit("@")), c, MENTION_PATTERN)
    n_url = count_where(F.contains(c, F.lit("http")), c, URL_PATTERN)
    n_emoji = count_where(F.octet_length(c) > clen, c, EMOJI_SCAN)      # every emoji takes more than one byte
    tw, qw = word_count(text), word_count(quoted)
    return [
        F.length(t).cast("long").alias("text_length"),
        F.length(q).cast("long").alias("quoted_text_length"),
        clen.cast("long").alias("combined_text_length"),
        tw.alias("text_word_count"),
        qw.alias("quoted_text_word_count"),
        (tw + qw).alias("combined_word_count"),
        mean_word_length(text).alias("avg_word_length_text"),
        mean_word_length(quoted).alias("avg_word_length_quoted"),
        n_hash.alias("hashtag_count"),
        n_ment.alias("mention_count"),
        n_url.alias("url_count"),
        n_emoji.alias("emoji_count"),
        (n_hash / clen).alias("hashtag_density"),
        (n_ment / clen).alias("mention_density"),
        (n_url / clen).alias("url_density"),
        (n_emoji / clen).alias("emoji_density"),
    ]


def informal_metric_columns(text="text", quoted="quoted_text") -> list[Column]:
    """TXT-9 ... TXT-11 (the model-based TXT-12 lives in ``vectors``)."""
    c = combined_text(text, quoted)
    return [
        (count_matches(c, UPPERCASE_CHAR) / F.length(c)).alias("uppercase_ratio"),
        count_matches(c, ELONGATION_PATTERN).alias("word_elongation_count"),
        count_where(F.contains(c, F.lit("!")) | F.contains(c, F.lit("?")), c, EXCESS_PUNCT_PATTERN)
        .alias("excessive_punctuation_count"),
    ]


def text_metrics(df: DataFrame, key: str = "post_id", text="text", quoted="quoted_text") -> DataFrame:
    """Text family without embeddings: key + 19 metric columns."""
    return df.select(F.col(key), *count_columns(text, quoted)).select(F.col(key), *counted_metric_columns())
