"""Driver-checked queries for the feature families (TXT, STR, ATT, EMO, TGT, PRJ, JN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import structure as S
from ..functions import text as X
from ..functions import vectors as V
from ..operators import assemble as A
from ..registry import register
from ..sources import fixtures as FX
from ..sources import io as IO

# DuckDB spellings of the same definitions (RE2 has no back-references and an
# ASCII \s, so white space and word characters are spelled out).
T_SQL = "coalesce(text, '')"
Q_SQL = "coalesce(quoted_text, '')"
C_SQL = "(coalesce(text, '') || ' ' || coalesce(quoted_text, ''))"
NONSPACE_SQL = r"[^\s\x{0B}\x{85}\p{Z}]"
WORD_SQL = r"[\p{L}\p{N}_]"


def _count(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, '{pattern}'))"


def _words(expr: str) -> str:
    return _count(expr, NONSPACE_SQL + "+")


# -- Step 0: the minimum slice -------------------------------------------
@register("label_text_profile", """
SELECT cast(total_trade_volume >= 50 AS int) AS label, count(*) AS n,
       round(avg(length(coalesce(text, ''))), 6) AS avg_text_length,
       round(avg(length(coalesce(quoted_text, ''))), 6) AS avg_quoted_length,
       round(avg(len(regexp_extract_all(coalesce(text, ''), '[^\\s\\x{0B}\\x{85}\\p{Z}]+'))), 6) AS avg_word_count
FROM posts GROUP BY 1""", ids=("TXT-1", "TXT-2", "TXT-3", "TGT-1"))
def label_text_profile(spark, sf_dir):
    p = FX.posts(spark, sf_dir)
    return (p.select(S.binarize("total_trade_volume", 50.0).alias("label"),
                     F.length(X.text_or_empty("text")).alias("tl"),
                     F.length(X.text_or_empty("quoted_text")).alias("ql"),
                     X.word_count("text").alias("wc"))
            .groupBy("label")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.round(F.avg("tl"), 6).alias("avg_text_length"),
                 F.round(F.avg("ql"), 6).alias("avg_quoted_length"),
                 F.round(F.avg("wc"), 6).alias("avg_word_count")))


# -- TXT ------------------------------------------------------------------
def _text_family(spark, sf_dir):
    p = FX.posts(spark, sf_dir)
    return p.select("post_id", *X.text_metric_columns(), *X.informal_metric_columns())


@register("text_lengths", f"""
SELECT post_id, length({T_SQL}) AS text_length, length({Q_SQL}) AS quoted_text_length,
       length({C_SQL}) AS combined_text_length FROM posts""", ids=("TXT-1", "TXT-2"))
def text_lengths(spark, sf_dir):
    return _text_family(spark, sf_dir).select("post_id", "text_length", "quoted_text_length",
                                              "combined_text_length")


@register("word_counts", f"""
SELECT post_id, {_words(T_SQL)} AS text_word_count, {_words(Q_SQL)} AS quoted_text_word_count,
       {_words(T_SQL)} + {_words(Q_SQL)} AS combined_word_count FROM posts""", ids=("TXT-3",))
def word_counts(spark, sf_dir):
    return _text_family(spark, sf_dir).select("post_id", "text_word_count", "quoted_text_word_count",
                                              "combined_word_count")


@register("avg_word_length", f"""
SELECT post_id,
  CASE WHEN {_words(T_SQL)} > 0 THEN {_count(T_SQL, NONSPACE_SQL)} / {_words(T_SQL)} ELSE cast(0 AS double) END
    AS avg_word_length_text,
  CASE WHEN {_words(Q_SQL)} > 0 THEN {_count(Q_SQL, NONSPACE_SQL)} / {_words(Q_SQL)} ELSE cast(0 AS double) END
    AS avg_word_length_quoted
FROM posts""", ids=("TXT-4",))
def avg_word_length(spark, sf_dir):
    return _text_family(spark, sf_dir).select("post_id", "avg_word_length_text", "avg_word_length_quoted")


@register("hashtag_mention_counts", f"""
SELECT post_id, {_count(C_SQL, '#' + WORD_SQL + '+')} AS hashtag_count,
       {_count(C_SQL, '@' + WORD_SQL + '+')} AS mention_count FROM posts
UNION ALL
SELECT conv_id * 1000 + turn AS post_id, {_count("(text || ' ')", '#' + WORD_SQL + '+')} AS hashtag_count,
       {_count("(text || ' ')", '@' + WORD_SQL + '+')} AS mention_count FROM conversations""",
          ids=("TXT-5",))
def hashtag_mention_counts(spark, sf_dir):
    conv = FX.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("post_id"), "text",
        F.lit(None).cast("string").alias("quoted_text"))
    both = FX.posts(spark, sf_dir).select("post_id", "text", "quoted_text").unionByName(conv)
    c = X.combined_text()
    return both.select("post_id", X.count_matches(c, X.HASHTAG_PATTERN).alias("hashtag_count"),
                       X.count_matches(c, X.MENTION_PATTERN).alias("mention_count"))


@register("url_count", f"""
SELECT post_id, {_count("(coalesce(image_url, '') || ' ')", X.URL_PATTERN)} AS url_count,
       {_count("(coalesce(image_url, '') || ' ')", X.URL_PATTERN)} / length(coalesce(image_url, '') || ' ')
         AS url_density
FROM posts""", ids=("TXT-6", "TXT-8"))
def url_count(spark, sf_dir):
    p = FX.posts(spark, sf_dir).select("post_id", F.col("image_url").alias("text"),
                                       F.lit(None).cast("string").alias("quoted_text"))
    return p.select("post_id", *X.text_metric_columns()).select("post_id", "url_count", "url_density")


def _emoji_sql_class() -> str:
    """Emoji beyond ASCII but regional indicators, as the ``regex`` library's property table has them: the oracles' own source."""
    import regex
    emoji = regex.compile(r"\p{Emoji}")
    return "[" + "".join(f"\\x{{{c:X}}}" for c in range(0x80, 0x1FB00) if emoji.match(chr(c)) and not 0x1F1E6 <= c <= 0x1F1FF) + "]"


EMOJI_SQL = _emoji_sql_class()
EMOJI_SUFFIX_SQL = ("CASE post_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' \U0001F600' "
                    "WHEN 2 THEN ' \U0001F389\U0001F44D\U0001F3FD \u2605\u2713\U0001F1E9\U0001F1EA' ELSE ' ❤️✨© ok' END")


def _emoji_suffix():
    k = F.col("post_id") % 4
    return (F.when(k == 0, F.lit("")).when(k == 1, F.lit(" \U0001F600"))
            .when(k == 2, F.lit(" \U0001F389\U0001F44D\U0001F3FD \u2605\u2713\U0001F1E9\U0001F1EA"))
            .otherwise(F.lit(" ❤️✨© ok")))


@register("emoji_count", f"""
SELECT post_id, {_count(f"(coalesce(text, '') || {EMOJI_SUFFIX_SQL} || ' ' || {Q_SQL})", EMOJI_SQL)}
         AS emoji_count,
       {_count(f"(coalesce(text, '') || {EMOJI_SUFFIX_SQL} || ' ' || {Q_SQL})", EMOJI_SQL)}
         / length(coalesce(text, '') || {EMOJI_SUFFIX_SQL} || ' ' || {Q_SQL}) AS emoji_density
FROM posts""", ids=("TXT-7", "TXT-8"))
def emoji_count(spark, sf_dir):
    p = FX.posts(spark, sf_dir).withColumn("text", F.concat(X.text_or_empty("text"), _emoji_suffix()))
    return p.select("post_id", *X.text_metric_columns()).select("post_id", "emoji_count", "emoji_density")


@register("element_density", f"""
SELECT post_id,
  {_count(C_SQL, '#' + WORD_SQL + '+')} / length({C_SQL}) AS hashtag_density,
  {_count(C_SQL, '@' + WORD_SQL + '+')} / length({C_SQL}) AS mention_density,
  {_count(C_SQL, X.URL_PATTERN)} / length({C_SQL}) AS url_density,
  {_count(C_SQL, EMOJI_SQL)} / length({C_SQL}) AS emoji_density
FROM posts""", ids=("TXT-8",))
def element_density(spark, sf_dir):
    return _text_family(spark, sf_dir).select("post_id", "hashtag_density", "mention_density",
                                              "url_density", "emoji_density")


@register("uppercase_ratio", f"""
SELECT post_id, {_count(C_SQL, r'\p{Lu}')} / length({C_SQL}) AS uppercase_ratio FROM posts""",
          ids=("TXT-9",))
def uppercase_ratio(spark, sf_dir):
    return _text_family(spark, sf_dir).select("post_id", "uppercase_ratio")


@register("word_elongation", f"""
SELECT post_id, len(list_filter(range(1, len(ch) - 1), lambda i:
         ch[i] = ch[i + 1] AND ch[i] = ch[i + 2] AND regexp_full_match(ch[i], '{WORD_SQL}')
         AND (i = 1 OR ch[i - 1] <> ch[i]))) AS word_elongation_count
FROM (SELECT post_id, string_split({C_SQL}, '') AS ch FROM posts) s""", ids=("TXT-10",))
def word_elongation(spark, sf_dir):
    return _text_family(spark, sf_dir).select("post_id", "word_elongation_count")


@register("excess_punct", f"""
SELECT post_id, {_count(C_SQL, '[!?]{2,}')} AS excessive_punctuation_count FROM posts""",
          ids=("TXT-11",))
def excess_punct(spark, sf_dir):
    return _text_family(spark, sf_dir).select("post_id", "excessive_punctuation_count")


TOKEN_DIM = 32
_GRAM_CODE = "list_sum(list_transform(range(1, len(g) + 1), lambda j: unicode(g[j]) * CAST(power(31, len(g) - j) AS BIGINT)))"


@register("token_variance", f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+')) AS word FROM documents),
d AS (SELECT DISTINCT word FROM w),
g AS (SELECT word, word[i:i + 2] AS g FROM (SELECT word, unnest(range(1, greatest(len(word) - 2, 1) + 1)) AS i FROM d)),
c AS (SELECT word, {_GRAM_CODE} AS code FROM g),
b AS (SELECT word, code % {TOKEN_DIM} AS bucket, sum(CASE WHEN (code // {TOKEN_DIM}) % 2 = 0 THEN 1 ELSE -1 END) AS x FROM c GROUP BY 1, 2),
v AS (SELECT word, (sum(x * x) - CAST(sum(x) AS DOUBLE) * sum(x) / {TOKEN_DIM}) / ({TOKEN_DIM} - 1) AS variance FROM b GROUP BY 1),
m AS (SELECT doc_id, avg(variance) AS mean FROM w JOIN v USING (word) GROUP BY 1)
SELECT documents.doc_id, round(coalesce(mean, 0), 6) AS perplexity_score FROM documents LEFT JOIN m USING (doc_id)""", ids=("TXT-12",))
def token_variance(spark, sf_dir):
    """Mean over a text's tokens of the variance of the token's vector."""
    docs = FX.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(V.token_variance("text", TOKEN_DIM), 6).alias("perplexity_score"))


@register("embedding_variance", """
SELECT label, count(*) AS n, round(avg(list_aggregate(embedding, 'var_samp')), 9) AS perplexity_score
FROM embeddings GROUP BY label""", ids=("TXT-12",))
def embedding_variance(spark, sf_dir):
    emb = FX.table(spark, sf_dir, "embeddings")
    return (emb.select("label", V.vec_variance("embedding").alias("v"))
            .groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                  F.round(F.avg("v"), 9).alias("perplexity_score")))


# -- STR -------------------------------------------------------------------
@register("type_one_hot", """
SELECT post_id,
  cast(coalesce(tweet_type = 'QUOTE', false) AS int) AS tweet_type_QUOTE,
  cast(coalesce(tweet_type = 'REPLY', false) AS int) AS tweet_type_REPLY,
  cast(coalesce(tweet_type = 'RETWEET', false) AS int) AS tweet_type_RETWEET,
  cast(coalesce(tweet_type = 'SINGLE', false) AS int) AS tweet_type_SINGLE
FROM posts""", ids=("STR-1",))
def type_one_hot(spark, sf_dir):
    p = FX.posts(spark, sf_dir)
    cats = S.fit_categories(p, "tweet_type")
    return p.select("post_id", *S.one_hot_columns("tweet_type", cats))


@register("media_type", """
SELECT post_id,
  cast(coalesce(image_url, '') <> '' AS int) AS has_image,
  cast(coalesce(image_url, '') = '' AS int) AS media_type_only_text,
  cast(coalesce(image_url, '') <> '' AND regexp_matches(coalesce(image_url, ''),
       '(?i)(video|tweet_video|amplify_video|video_thumb)') AS int) AS media_type_video,
  cast(coalesce(image_url, '') <> '' AND NOT regexp_matches(coalesce(image_url, ''),
       '(?i)(video|tweet_video|amplify_video|video_thumb)') AS int) AS media_type_image
FROM posts""", ids=("STR-2", "STR-3"))
def media_type(spark, sf_dir):
    return FX.posts(spark, sf_dir).select("post_id", *S.media_columns())


@register("quote_structure", f"""
SELECT post_id, cast(length({Q_SQL}) > 0 AS int) AS has_quoted_text,
  CASE WHEN length({T_SQL}) > 0 AND length({Q_SQL}) > 0 THEN length({T_SQL}) / length({Q_SQL}) END
    AS text_quoted_ratio
FROM posts""", ids=("STR-4", "STR-5"))
def quote_structure(spark, sf_dir):
    return FX.posts(spark, sf_dir).select("post_id", *S.quote_columns())


VECTOR_PAIRS_SQL = """
SELECT a.vec_id, a.embedding AS main_vec, b.embedding AS quoted_vec,
       (a.vec_id % 3 = 0 AND b.vec_id IS NOT NULL) AS has_quote
FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


@register("vector_contrast", f"""
SELECT vec_id, round(c, 9) AS main_quoted_contrast, round(least(c * 0.8, 1.0), 9) AS internal_diversity,
       round((c + least(c * 0.8, 1.0)) / 2, 9) AS combined_diversity
FROM (SELECT vec_id, CASE WHEN has_quote AND list_sum(main_vec) <> 0 AND list_sum(quoted_vec) <> 0
                          THEN 1 - list_cosine_similarity(main_vec::double[], quoted_vec::double[])
                          ELSE cast(0 AS double) END AS c
      FROM ({VECTOR_PAIRS_SQL}) p) s""", ids=("STR-6",))
def vector_contrast(spark, sf_dir):
    emb = FX.table(spark, sf_dir, "embeddings")
    q = emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("quoted_vec"))
    pairs = emb.select("vec_id", F.col("embedding").alias("main_vec")).join(q, "vec_id", "left")
    has_q = (F.col("vec_id") % 3 == 0) & F.col("quoted_vec").isNotNull()
    cols = V.contrast_columns("main_vec", "quoted_vec", has_q)
    return pairs.select("vec_id", *cols).select(
        "vec_id", *[F.round(F.col(c), 9).alias(c) for c in
                    ("main_quoted_contrast", "internal_diversity", "combined_diversity")])


@register("temporal", """
SELECT post_id, cast(hour(created_at) AS int) AS hour, cast(isodow(created_at) - 1 AS int) AS day_of_week,
       cast(isodow(created_at) - 1 >= 5 AS int) AS is_weekend FROM posts""", ids=("STR-7",))
def temporal(spark, sf_dir):
    p = FX.posts(spark, sf_dir)
    return p.select("post_id", *S.temporal_columns(p, "created_at"))


# -- ATT / EMO ----------------------------------------------------------------
@register("attribute_columns", "SELECT * FROM attrs", ids=("ATT-1",))
def attribute_columns(spark, sf_dir):
    p = FX.with_attributes(FX.posts(spark, sf_dir).select("post_id"))
    return p.select("post_id", *S.attribute_columns())


_EM_OTHERS = [n for n in S.EM_NAMES if n != S.NEUTRAL_EM]


@register("eid", f"""
SELECT post_id, round(({' + '.join(_EM_OTHERS)} - EM4) * greatest({', '.join(_EM_OTHERS)})
       / sqrt(1 + {' + '.join(f'cast({n} > 0.7 AS int)' for n in _EM_OTHERS)}), 9) AS eid
FROM attrs""", ids=("ATT-2",))
def eid(spark, sf_dir):
    p = FX.with_attributes(FX.posts(spark, sf_dir).select("post_id"))
    return p.select("post_id", F.round(S.eid(), 9).alias("eid"))


_POS = " + ".join(f"emotion_{e}" for e in S.POSITIVE_EMOTIONS)
_NEG = " + ".join(f"emotion_{e}" for e in S.NEGATIVE_EMOTIONS)
_ALL = " + ".join(f"emotion_{e}" for e in S.EMOTION_LABELS)


@register("emotional_valence", f"""
SELECT post_id, round(CASE WHEN ({_POS}) + ({_NEG}) > 0
  THEN (({_POS}) - ({_NEG})) / (({_POS}) + ({_NEG})) ELSE cast(0 AS double) END, 9) AS emotional_valence
FROM emo""", ids=("EMO-1",))
def emotional_valence(spark, sf_dir):
    e = FX.with_emotions(FX.posts(spark, sf_dir).select("post_id"))
    return e.select("post_id", F.round(S.emotion_summary_columns()[0], 9).alias("emotional_valence"))


@register("emotional_intensity", f"SELECT post_id, round({_ALL}, 9) AS emotional_intensity FROM emo",
          ids=("EMO-2",))
def emotional_intensity(spark, sf_dir):
    e = FX.with_emotions(FX.posts(spark, sf_dir).select("post_id"))
    return e.select("post_id", F.round(S.emotion_summary_columns()[1], 9).alias("emotional_intensity"))


# -- TGT ------------------------------------------------------------------------
@register("binarize_target", "SELECT event_id, cast(value >= 50 AS int) AS label FROM events",
          ids=("TGT-1",))
def binarize_target(spark, sf_dir):
    ev = FX.table(spark, sf_dir, "events")
    return ev.select("event_id", S.binarize("value", 50.0).alias("label"))


@register("apply_threshold", "SELECT event_id, cast(score > 0.5 AS int) AS decision FROM scored",
          ids=("TGT-2",))
def apply_threshold(spark, sf_dir):
    return FX.scored(spark, sf_dir).select("event_id", S.apply_threshold("score", 0.5).alias("decision"))


# -- JN / PRJ / SRC-4 --------------------------------------------------------------
@register("image_key", "SELECT page_id, md5(url) AS image_key FROM pages", ids=("SRC-4",))
def image_key(spark, sf_dir):
    pages = FX.table(spark, sf_dir, "pages")
    return pages.select("page_id", IO.image_key("url").alias("image_key"))


@register("image_availability", f"""
SELECT post_id, cast(i.k IS NOT NULL AS int) AS image_available
FROM posts p LEFT JOIN image_keys i
  ON i.k = md5(p.image_url)
WHERE coalesce(p.image_url, '') <> ''""", ids=("ML-5", "SRC-4"))
def image_availability(spark, sf_dir):
    p = FX.posts(spark, sf_dir)
    images = FX.images(spark, sf_dir)
    return A.image_availability(p, images).select("post_id", "image_available")


@register("drop_invalid_posts", f"""
SELECT post_id, total_trade_volume FROM posts p
WHERE NOT (coalesce(p.image_url, '') <> '' AND md5(p.image_url) NOT IN
           (SELECT k FROM image_keys))""",
          ids=("JN-2",))
def drop_invalid_posts(spark, sf_dir):
    p = FX.posts(spark, sf_dir)
    images = FX.images(spark, sf_dir)
    return A.with_valid_images(p.select("post_id", "image_url", "total_trade_volume"), images).select("post_id", "total_trade_volume")


@register("align_vectors", """
SELECT d.doc_id, len(coalesce(e.embedding, [])) AS src_dims,
       round(coalesce(list_sum(e.embedding::double[]), 0), 6) AS vec_sum,
       round(coalesce(cast(e.embedding[1] AS double), 0), 9) AS first_component
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""", ids=("JN-3",))
def align_vectors(spark, sf_dir):
    docs = FX.table(spark, sf_dir, "documents").select("doc_id")
    emb = FX.table(spark, sf_dir, "embeddings")
    dims = emb.select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("src_dims"))
    al = V.align_vectors(docs, emb, "doc_id", "vec_id", "embedding", 64)
    return (al.join(dims, "doc_id", "left")
            .select("doc_id", F.coalesce("src_dims", F.lit(0)).alias("src_dims"),
                    F.round(V.vec_sum("embedding"), 6).alias("vec_sum"),
                    F.round(F.col("embedding")[0], 9).alias("first_component")))


@register("vector_default", """
SELECT vec_id, 72 AS dims, round(list_sum(embedding::double[]), 6) AS vec_sum,
       round(cast(embedding[64] AS double), 9) AS component_64, cast(0 AS double) AS component_72
FROM embeddings""", ids=("PRJ-4",))
def vector_default(spark, sf_dir):
    emb = FX.table(spark, sf_dir, "embeddings")
    v = emb.select("vec_id", V.vector_default("embedding", 72).alias("v"))
    return v.select("vec_id", F.size("v").alias("dims"), F.round(V.vec_sum("v"), 6).alias("vec_sum"),
                    F.round(F.col("v")[63], 9).alias("component_64"), F.col("v")[71].alias("component_72"))


@register("join_predictions", """
SELECT e.event_id, cast(e.value >= 50 AS int) AS actual, s.score AS predicted
FROM events e JOIN scored s ON s.event_id = e.event_id""", ids=("JN-4",))
def join_predictions(spark, sf_dir):
    actual = FX.table(spark, sf_dir, "events").select("event_id", S.binarize("value").alias("actual"))
    pred = FX.scored(spark, sf_dir).select("event_id", F.col("score").alias("predicted"))
    return A.join_on_key(actual, pred, "event_id")


@register("assemble_features", f"""
SELECT p.post_id, length({C_SQL}) AS combined_text_length, cast(hour(created_at) AS int) AS hour,
       cast(i.k IS NOT NULL AS int) AS image_available
FROM posts p LEFT JOIN image_keys i
  ON i.k = md5(p.image_url)""", ids=("JN-1",))
def assemble_features(spark, sf_dir):
    p = FX.posts(spark, sf_dir)
    images = FX.images(spark, sf_dir)
    fam_text = p.select("post_id", F.length(X.combined_text()).cast("long").alias("combined_text_length"))
    fam_time = p.select("post_id", S.temporal_columns(p)[0])
    fam_img = A.image_availability(p, images, keep_missing=True).select("post_id", "image_available")
    return A.join_families("post_id", [fam_text, fam_time, fam_img])


@register("select_features", f"""
SELECT post_id, length({T_SQL}) AS text_length, {_words(T_SQL)} AS text_word_count FROM posts""",
          ids=("PRJ-1",))
def select_features(spark, sf_dir):
    fam = _text_family(spark, sf_dir)
    return A.select_features(fam, ["text_length", "text_word_count"], key="post_id")
