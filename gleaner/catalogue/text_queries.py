"""Text cleaning and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalogue import inputs as I, sql as S
from gleaner.catalogue.registry import query, table
from gleaner.functions import classify as K, fixed, text as T
from gleaner.operators import leads as L, pages as P

# phrases, stop words and lexicons that occur in the given documents
PHRASES = ["licensed under the apache license, version 2.0.", "all rights reserved", "privacy policy"]
STOPWORDS = {
    "en": fixed.ENGLISH_STOPWORDS,
    "de": ["der", "die", "das", "und", "von", "ist", "nicht", "sich", "auch", "ein", "eine", "zu", "den", "dem"],
    "fr": ["le", "la", "les", "de", "du", "des", "un", "une", "que", "qui", "pour", "avec", "dans", "et", "sur"],
    "es": ["el", "la", "los", "de", "del", "que", "por", "con", "para", "su", "en", "un", "una", "y"],
}
TYPES = {"business": ["license", "tour"], "blog": ["token"], "review": ["rating"], "social": ["mail"]}
VERTICALS = ["dining", "tour", "inn", "deal"]
INTENTS = {"commercial": ["deal", "tour"], "informational": ["that", "les"]}
SPAM = [r"rights\s+reserved", "token", r"apache\s+license", "click here"]

_DOC = "SELECT doc_id, text FROM documents"


@query("html_visible_text", f"SELECT page_id, {S.text_of('html')} AS text FROM ({I.ALL_PAGES_SQL}) p")
def _(spark, sf):
    return I.all_pages(spark, sf).select("page_id", T.html_to_text("html").alias("text"))


@query(
    "whitespace_clean",
    "SELECT 'd' AS part, doc_id AS a, 0 AS b, trim({c}) AS text FROM documents UNION ALL "
    "SELECT 'c' AS part, conv_id AS a, turn AS b, trim({c}) AS text FROM conversations".format(
        c=S.sub(S.sub("text || ' ​  ﻿x\t\ty '", f"[{S.WS}]+", " "), "[​‌‍﻿]")
    ),
)
def _(spark, sf):
    noisy = T.clean_whitespace(F.concat("text", F.lit(" ​  ﻿x\t\ty ")))
    docs = table(spark, sf, "documents").select(
        F.lit("d").alias("part"), F.col("doc_id").alias("a"), F.lit(0).cast("bigint").alias("b"), noisy.alias("text")
    )
    turns = table(spark, sf, "conversations").select(
        F.lit("c").alias("part"), F.col("conv_id").alias("a"), F.col("turn").alias("b"), noisy.alias("text")
    )
    return docs.union(turns)


def _lines_kept(text: str) -> str:
    return (
        f"list_filter(regexp_split_to_array({text}, '\\r\\n|[\\n\\r]'), "
        f"lambda x: lower({S.strip('x')}) NOT IN ({', '.join(S.q(p) for p in PHRASES)}))"
    )


@query("boilerplate_lines", f"SELECT doc_id, array_to_string({_lines_kept('text')}, ' ') AS text FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.remove_boilerplate("text", PHRASES).alias("text"))


# documents have no blank lines, so a block ends where a sentence ends a line
_BLOCKS = r"regexp_replace(text, '\.\n', '.' || chr(10) || chr(10), 'g')"


@query(
    "largest_text_block",
    f"""WITH b AS (SELECT doc_id, unnest(regexp_split_to_array({_BLOCKS}, '\\n{{2,}}')) AS block,
      generate_subscripts(regexp_split_to_array({_BLOCKS}, '\\n{{2,}}'), 1) AS i FROM documents)
    SELECT doc_id, block FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(block) DESC, i) AS rn FROM b)
    WHERE rn = 1""",
)
def _(spark, sf):
    blocks = F.regexp_replace("text", r"\.\n", ".\n\n")
    return table(spark, sf, "documents").select("doc_id", T.largest_block(blocks).alias("block"))


def _word_set(text: str) -> str:
    apart = S.sub(f"lower({text})", r"n?['\x{2019}](?:t|s|m|d|ll|re|ve)\b", " ")
    return f"list_distinct({S.every(apart, r'[\p{L}\p{N}_-]+')})"


def _language(words: str) -> str:
    counts = {lang: f"len(list_intersect({words}, {S.sql_list(ws)}))" for lang, ws in STOPWORDS.items()}
    best = f"greatest({', '.join(counts.values())})"
    whens = " ".join(f"WHEN {n} = {best} THEN '{lang}'" for lang, n in counts.items())
    return f"CASE WHEN {best} <= 3 THEN NULL {whens} END"


@query(
    "stopword_language",
    f"""WITH w AS (SELECT doc_id, lang, {_word_set('text')} AS words FROM documents)
    SELECT doc_id, lang AS labelled, coalesce({_language('words')}, 'unknown') AS language,
      len(list_intersect(words, {S.sql_list(fixed.ENGLISH_STOPWORDS)})) > 3 AS is_english FROM w""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("labelled"),
        F.coalesce(T.detect_language("text", STOPWORDS), F.lit("unknown")).alias("language"),
        T.detect_language("text").isNotNull().alias("is_english"),
    )


@query("bytes_to_utf8", "SELECT doc_id, text FROM documents")
def _(spark, sf):
    # bytes that are not UTF-8 at both ends and between every two paragraphs
    bad = F.expr("concat(unhex('FF'), encode(text, 'UTF-8'), unhex('C3FE'))")
    return table(spark, sf, "documents").select("doc_id", T.to_utf8(bad, binary=True).alias("text"))


_CLEAN = S.text_of("html")


@query(
    "clean_pages",
    f"""WITH kept AS (SELECT page_id, array_to_string({_lines_kept(_CLEAN)}, chr(10)) AS t FROM ({I.ALL_PAGES_SQL}) p),
    b AS (SELECT page_id, unnest(regexp_split_to_array(t, '\\n{{2,}}')) AS block,
      generate_subscripts(regexp_split_to_array(t, '\\n{{2,}}'), 1) AS i FROM kept),
    c AS (SELECT page_id, trim({S.sub(S.sub('block', f'[{S.WS}]+', ' '), '[​‌‍﻿]')}) AS clean_text FROM
      (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(block) DESC, i) AS rn FROM b) WHERE rn = 1),
    w AS (SELECT page_id, clean_text, {_word_set('clean_text')} AS words FROM c)
    SELECT page_id, clean_text, coalesce({_language('words')}, 'unknown') AS language FROM w""",
)
def _(spark, sf):
    return P.clean_pages(I.all_pages(spark, sf), phrases=PHRASES, stopwords=STOPWORDS)


# --- classification ------------------------------------------------------------------------
@query("content_type", f"SELECT doc_id, {S.first_of_lexicon('lower(text)', TYPES, S.q('other'))} AS type FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", K.content_type("text", TYPES).alias("type"))


@query(
    "content_vertical",
    f"SELECT doc_id, {S.first_of_lexicon('lower(text)', {v: [v] for v in VERTICALS}, S.q('other'))} AS vertical FROM documents",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", K.vertical("text", VERTICALS).alias("vertical"))


@query(
    "content_intent",
    f"SELECT doc_id, {S.first_of_lexicon('lower(text)', INTENTS, S.q('unknown'))} AS intent FROM documents",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", K.intent("text", INTENTS).alias("intent"))


_QUALITY = f"(((least(length(text), 1000) + 5) // 10) + CASE WHEN {S.any_of('lower(text)', VERTICALS)} THEN 20 ELSE 0 END) / 100.0"


@query(
    "content_quality",
    f"""SELECT d.doc_id, {_QUALITY} AS quality_score, coalesce(l.quality, -1) AS labelled
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(spark, sf):
    scored = table(spark, sf, "documents").select("doc_id", K.quality("text", VERTICALS).alias("quality_score"))
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("labelled"))
    return scored.join(labels, "doc_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(-1)))


_SPAM = r"(?i)rights\s+reserved|token|apache\s+license|click here"


@query("spam_flag", f"SELECT doc_id, regexp_matches(text, '{_SPAM}') AS is_spam FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", K.is_spam("text", SPAM).alias("is_spam"))


def _ranked(source: str, key: str) -> str:
    return f"""SELECT {key}, w, count(*) AS n, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, min(i)) AS rn
      FROM (SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM
        (SELECT {key}, {S.every('lower(text)', '[\\p{L}\\p{N}_]{4,}')} AS ws FROM {source}) a) b GROUP BY {key}, w"""


@query(
    "top_keywords",
    f"SELECT doc_id, rn AS rank, w AS keyword, n FROM ({_ranked('documents', 'doc_id')}) r WHERE rn <= 10",
)
def _(spark, sf):
    out = L.keyword_table(table(spark, sf, "documents"))
    return out.select("doc_id", F.col("rank").cast("bigint").alias("rank"), "keyword", F.col("n").cast("bigint").alias("n"))


@query(
    "corpus_keywords",
    f"SELECT w AS keyword, count(*) AS n_docs, sum(n)::BIGINT AS n FROM ({_ranked('documents', 'doc_id')}) r GROUP BY w",
)
def _(spark, sf):
    return L.corpus_keywords(table(spark, sf, "documents"))


@query(
    "conversation_keywords",
    f"""SELECT conv_id, rn AS rank, w AS keyword, n FROM ({_ranked(
        "(SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id) g", 'conv_id')}) r
    WHERE rn <= 5""",
)
def _(spark, sf):
    out = L.grouped_keywords(table(spark, sf, "conversations"), "conv_id", "turn", top_n=5)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "classify_documents",
    f"""WITH k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY rn) AS keywords FROM ({_ranked('documents', 'doc_id')}) r
      WHERE rn <= 10 GROUP BY doc_id)
    SELECT d.doc_id, {S.first_of_lexicon('lower(text)', TYPES, S.q('other'))} AS type,
      {S.first_of_lexicon('lower(text)', {v: [v] for v in VERTICALS}, S.q('other'))} AS vertical,
      {S.first_of_lexicon('lower(text)', INTENTS, S.q('unknown'))} AS intent, {_QUALITY} AS quality_score,
      regexp_matches(text, '{_SPAM}') AS is_spam, coalesce(keywords, '') AS keywords
    FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id""",
)
def _(spark, sf):
    out = L.classify_documents(
        table(spark, sf, "documents"), types=TYPES, verticals=VERTICALS, intents=INTENTS, spam=SPAM
    )
    return out.withColumn("keywords", F.array_join("keywords", " "))
