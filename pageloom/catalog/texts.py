"""Catalog: text, scoring and entity queries over documents and conversations."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom import vocab
from pageloom.catalog import sql
from pageloom.functions import words
from pageloom.operators import entities, scoring, text
from pageloom.plans.staging import stage

# A vocabulary that occurs in the invented words of the test tables.
PREFIXES = ["the", "ther", "tion", "ent", "ou", "ver", "cion", "qu", "q"]

# Words put in place of frequent invented ones, so that default lists match.
ENGLISH = [
    (" de ", " elections "), (" the ", " marketing "), (" der ", " viruses "),
    (" la ", " healthy "), (" of ", " football "), (" en ", " governments "),
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "role", "text")


def english(spark: SparkSession, sf_dir: str) -> DataFrame:
    column = F.col("text")
    for old, new in ENGLISH:
        column = F.replace(column, F.lit(old), F.lit(new))
    return documents(spark, sf_dir).withColumn("text", column)


def english_sql() -> str:
    column = "text"
    for old, new in ENGLISH:
        column = f"replace({column}, '{old}', '{new}')"
    return f"(SELECT doc_id, {column} AS text FROM documents)"


def _joined(name: str):
    return F.array_join(name, ",").alias(name)


def split_words(spark, sf_dir):
    pieces = words.split_words(F.col("text"))
    return (
        documents(spark, sf_dir)
        .select(F.explode(pieces).alias("word"))
        .filter("word <> ''")
        .groupBy("word").agg(F.count("*").alias("n"))
    )


def lemmatise(spark, sf_dir):
    pieces = words.split_words(F.col("text"))
    return (
        documents(spark, sf_dir)
        .select(F.explode(pieces).alias("w"))
        .groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))
        .filter(words.keep_word(F.col("word"), vocab.STOP_WORDS))
        .select("word", "n", words.lemmatise(F.col("word")).alias("lemma"))
    )


def stop_word_counts(spark, sf_dir):
    stop = vocab.vocabulary(spark).filter("list = 'stop_word'").select("word")
    found = (
        documents(spark, sf_dir)
        .select(F.explode(words.split_words(F.col("text"))).alias("w"))
        .groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))
    )
    return found.join(F.broadcast(stop), "word")


def tokens_of_documents(spark, sf_dir):
    return text.tokenize(documents(spark, sf_dir), ["doc_id"], "text").select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens")
    )


def term_freq_documents(spark, sf_dir):
    return text.term_freq(documents(spark, sf_dir), ["doc_id"], "text", unique_keys=True)


def term_freq_conversations(spark, sf_dir):
    return text.term_freq(conversations(spark, sf_dir), ["conv_id", "role"], "text")


def page_totals_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    counts = text.term_freq(docs, ["doc_id"], "text", unique_keys=True)
    return text.term_totals(counts, ["doc_id"], PREFIXES, every=docs)


def _scores(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(
        *keys, "n_tokens", "unique_terms", "topic_hits",
        F.round("relevance_score", 6).alias("relevance"), _joined("top_keywords"),
        F.col("inferred_category").alias("category"),
    )


def _scores_sql(source: str, keys: str, prefixes) -> str:
    return (
        f"SELECT {keys}, n_tokens, unique_terms, topic_hits, round(relevance, 6) AS relevance, "
        f"array_to_string(top_keywords, ',') AS top_keywords, category "
        f"FROM ({sql.scores(source, keys, 'text', prefixes)})"
    )


def relevance_documents(spark, sf_dir):
    return _scores(scoring.score_texts(documents(spark, sf_dir), ["doc_id"], "text", PREFIXES), ["doc_id"])


def relevance_default_topics(spark, sf_dir):
    return _scores(scoring.score_texts(english(spark, sf_dir), ["doc_id"], "text"), ["doc_id"])


def relevance_conversations(spark, sf_dir):
    scored = scoring.score_groups(conversations(spark, sf_dir), ["conv_id"], "text", PREFIXES)
    return _scores(scored, ["conv_id"])


def score_components(spark, sf_dir):
    scored = scoring.score_texts(documents(spark, sf_dir), ["doc_id"], "text", PREFIXES)
    n, u, h = F.col("n_tokens"), F.col("unique_terms"), F.col("topic_hits")
    return scored.select(
        "doc_id",
        F.round(F.coalesce(words.tf_ratio(h, n), F.lit(0.0)), 6).alias("tf_ratio"),
        F.round(words.richness(n), 6).alias("richness"),
        F.round(F.coalesce(words.diversity(u, n), F.lit(0.0)), 6).alias("diversity"),
    )


def threshold_documents(spark, sf_dir):
    scored = scoring.score_texts(documents(spark, sf_dir), ["doc_id"], "text", PREFIXES)
    return scoring.keep_relevant(scored, 0.35).select("doc_id", F.round("relevance_score", 6).alias("relevance"))


def category_counts(spark, sf_dir):
    scored = scoring.score_texts(english(spark, sf_dir), ["doc_id"], "text")
    return scored.groupBy(F.col("inferred_category").alias("category")).agg(F.count("*").alias("n"))


def topic_hits_from_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    counts = text.term_freq(docs, ["doc_id"], "text", unique_keys=True)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    vocabulary = items.select(F.explode(words.tokens(F.col("text"))).alias("prefix"))
    return scoring.topic_hits_from_table(counts, ["doc_id"], vocabulary, every=docs)


def topic_hits_with_repeats(spark, sf_dir):
    """The vocabulary as it is listed: a prefix counts as often as it stands there."""
    docs = documents(spark, sf_dir)
    counts = text.term_freq(docs, ["doc_id"], "text", unique_keys=True)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    vocabulary = items.select(F.explode(words.tokens(F.col("text"))).alias("prefix"))
    return scoring.topic_hits_from_table(counts, ["doc_id"], vocabulary, every=docs, repeats=True)


def tf_idf_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    counts = stage(text.term_freq_with_total(docs, ["doc_id"], "text"), "term-counts")
    n_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.count("*")).scalar()
    weighted = scoring.tf_idf(counts, ["doc_id"], n_docs, text.document_freq(counts))
    return weighted.withColumn("weight", F.round("weight", 6))


def run_metrics(spark, sf_dir):
    scored = scoring.score_texts(documents(spark, sf_dir), ["doc_id"], "text", PREFIXES)
    return scoring.run_metrics(scored, threshold=0.35).select("pages_in", "read_errors", "discarded", "kept")


def diagnostics(spark, sf_dir):
    scored = scoring.score_texts(english(spark, sf_dir), ["doc_id"], "text")
    return scoring.diagnostics(scored, ["doc_id"]).withColumn(
        "relevance_score", F.round("relevance_score", 6)
    )


def benchmark_dictionary(spark, sf_dir):
    """Entries from the benchmark items: all words, and all pairs of neighbouring words."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").select(
        F.filter(words.split_words(F.col("text")), lambda w: w != "").alias("w")
    )
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, F.lit(2)), " "))
    entries = items.select(F.explode("w").alias("text")).unionByName(
        items.filter(F.size("w") > 1).select(F.explode(pairs).alias("text"))
    )
    labels = F.array(*[F.lit(x) for x in vocab.ENTITY_LABELS])
    pick = F.pmod(F.octet_length("text"), F.lit(len(vocab.ENTITY_LABELS))).cast("int")
    return entries.distinct().withColumn("label", F.get(labels, pick))


def dictionary_spans(spark, sf_dir):
    return entities.dictionary_spans(
        documents(spark, sf_dir), ["doc_id"], "text", benchmark_dictionary(spark, sf_dir), max_words=2
    ).select("doc_id", F.col("seq").cast("bigint").alias("seq"), "text", "label")


def first_entities(spark, sf_dir):
    spans = entities.dictionary_spans(
        documents(spark, sf_dir), ["doc_id"], "text", benchmark_dictionary(spark, sf_dir), max_words=2
    )
    return entities.first_entities(spans, ["doc_id"]).withColumn("rank", F.col("rank").cast("bigint"))


def collected_entities(spark, sf_dir):
    docs = documents(spark, sf_dir)
    spans = entities.dictionary_spans(docs, ["doc_id"], "text", benchmark_dictionary(spark, sf_dir), max_words=2)
    lists = entities.collect_entities(spans, ["doc_id"], every=docs)
    return lists.select(
        "doc_id",
        F.array_join(
            F.transform("named_entities", lambda e: F.concat(e["text"], F.lit("/"), e["kind"])), ","
        ).alias("entities"),
    )


def spans_sql(table: str, key: str, text: str) -> str:
    """CTEs ``spans`` and ``firsts``: places of the benchmark dictionary in a table's texts."""
    return f"""
WITH w AS (SELECT {key}, list_filter(regexp_split_to_array({text}, {sql.WORD_BREAK}), lambda x: x <> '') AS w FROM {table}),
bw AS (SELECT list_filter(regexp_split_to_array(text, {sql.WORD_BREAK}), lambda x: x <> '') AS w FROM benchmark),
dict AS (
  SELECT DISTINCT text, [{sql.quoted(vocab.ENTITY_LABELS)}][(strlen(text) % {len(vocab.ENTITY_LABELS)}) + 1] AS label
  FROM (SELECT unnest(w) AS text FROM bw
        UNION SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) AS i FROM bw))
),
places AS (SELECT {key}, w, unnest(range(0, len(w))) AS i FROM w),
grams AS (
  SELECT {key}, i * 2 AS seq, w[i + 1] AS text FROM places
  UNION ALL SELECT {key}, i * 2 + 1, w[i + 1] || ' ' || w[i + 2] FROM places WHERE i + 1 < len(w)
),
spans AS (
  SELECT {key}, CAST(min(seq) AS BIGINT) AS seq, text, min(label) AS label
  FROM grams JOIN dict USING (text) GROUP BY {key}, text
),
firsts AS (
  SELECT {key}, rank, text, replace(upper(label), ' ', '_') AS kind FROM (
    SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY seq, text) AS rank FROM spans
  ) WHERE rank <= {vocab.ENTITIES_PER_PAGE}
)
"""


_SPANS_SQL = spans_sql("documents", "doc_id", "text")

_RAW_WORDS = f"(SELECT unnest(regexp_split_to_array(text, {sql.WORD_BREAK})) AS w FROM documents)"
_DOC_TF = sql.term_freq("documents", "doc_id", "text")
_DOC_SCORES = sql.scores("documents", "doc_id", "text", PREFIXES)

QUERIES = {
    f.__name__: f
    for f in (
        split_words, lemmatise, stop_word_counts, tokens_of_documents, term_freq_documents,
        term_freq_conversations, page_totals_documents, relevance_documents,
        relevance_default_topics, relevance_conversations, score_components,
        threshold_documents, category_counts, topic_hits_from_table, topic_hits_with_repeats, tf_idf_documents,
        run_metrics, diagnostics, dictionary_spans, first_entities, collected_entities,
    )
}

ORACLES = {
    "split_words": f"SELECT w AS word, count(*) AS n FROM {_RAW_WORDS} WHERE w <> '' GROUP BY w",
    "lemmatise": f"""SELECT word, n, {sql.lemma('word')} AS lemma FROM (
        SELECT lower(w) AS word, count(*) AS n FROM {_RAW_WORDS} GROUP BY 1)
        WHERE strlen(word) >= 3 AND word NOT IN ({sql.STOP})""",
    "stop_word_counts": f"""SELECT lower(w) AS word, count(*) AS n FROM {_RAW_WORDS}
        WHERE lower(w) IN ({sql.STOP}) GROUP BY 1""",
    "tokens_of_documents": f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens
        FROM (SELECT doc_id, {sql.tokens('text')} AS t FROM documents)""",
    "term_freq_documents": _DOC_TF,
    "term_freq_conversations": sql.term_freq("conversations", "conv_id, role", "text"),
    "page_totals_documents": f"SELECT doc_id, n_tokens, unique_terms, topic_hits FROM ({_DOC_SCORES})",
    "relevance_documents": _scores_sql("documents", "doc_id", PREFIXES),
    "relevance_default_topics": _scores_sql(english_sql(), "doc_id", vocab.TOPIC_TERMS),
    "relevance_conversations": _scores_sql("conversations", "conv_id", PREFIXES),
    "score_components": f"""SELECT doc_id,
        round(CASE WHEN n_tokens = 0 THEN 0.0::DOUBLE ELSE least(topic_hits::DOUBLE / n_tokens::DOUBLE, 1.0::DOUBLE) END, 6) AS tf_ratio,
        round(sqrt(least(n_tokens::DOUBLE / 300.0::DOUBLE, 1.0::DOUBLE)), 6) AS richness,
        round(CASE WHEN n_tokens = 0 THEN 0.0::DOUBLE ELSE least(unique_terms::DOUBLE / n_tokens::DOUBLE, 1.0::DOUBLE) END, 6) AS diversity
        FROM ({_DOC_SCORES})""",
    "threshold_documents": f"SELECT doc_id, round(relevance, 6) AS relevance FROM ({_DOC_SCORES}) WHERE relevance >= 0.35::DOUBLE",
    "category_counts": f"""SELECT category, count(*) AS n
        FROM ({sql.scores(english_sql(), 'doc_id', 'text')}) GROUP BY category""",
    "topic_hits_from_table": f"""
        WITH tf AS ({_DOC_TF}),
        v AS (SELECT DISTINCT unnest({sql.tokens('text')}) AS prefix FROM benchmark),
        n AS (SELECT DISTINCT length(prefix) AS n FROM v),
        p AS (SELECT term, count(*) AS n FROM (SELECT term, left(term, n) AS prefix
              FROM (SELECT DISTINCT term FROM tf) JOIN n ON n <= length(term)) JOIN v USING (prefix) GROUP BY term)
        SELECT doc_id, CAST(coalesce(sum(tf * coalesce(n, 0)), 0) AS BIGINT) AS topic_hits
        FROM documents LEFT JOIN tf USING (doc_id) LEFT JOIN p USING (term) GROUP BY doc_id""",
    "topic_hits_with_repeats": f"""
        WITH tf AS ({_DOC_TF}),
        v AS (SELECT unnest({sql.tokens('text')}) AS prefix FROM benchmark),
        n AS (SELECT DISTINCT length(prefix) AS n FROM v),
        p AS (SELECT term, count(*) AS n FROM (SELECT term, left(term, n) AS prefix
              FROM (SELECT DISTINCT term FROM tf) JOIN n ON n <= length(term)) JOIN v USING (prefix) GROUP BY term)
        SELECT doc_id, CAST(coalesce(sum(tf * coalesce(n, 0)), 0) AS BIGINT) AS topic_hits
        FROM documents LEFT JOIN tf USING (doc_id) LEFT JOIN p USING (term) GROUP BY doc_id""",
    "tf_idf_documents": f"""
        WITH tf AS ({_DOC_TF}),
        d AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        n AS (SELECT doc_id, sum(tf)::DOUBLE AS n FROM tf GROUP BY doc_id)
        SELECT doc_id, term, tf, df,
               round(tf / n * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE), 6) AS weight
        FROM tf JOIN d USING (term) JOIN n USING (doc_id)""",
    "run_metrics": f"""SELECT count(*) AS pages_in, CAST(0 AS BIGINT) AS read_errors,
        count(*) FILTER (relevance < 0.35::DOUBLE) AS discarded,
        count(*) FILTER (relevance >= 0.35::DOUBLE) AS kept FROM ({_DOC_SCORES})""",
    "diagnostics": f"""SELECT doc_id, n_tokens, unique_terms, round(relevance, 6) AS relevance_score,
        category AS inferred_category FROM ({sql.scores(english_sql(), 'doc_id', 'text')})""",
    "dictionary_spans": _SPANS_SQL + "SELECT doc_id, seq, text, label FROM spans",
    "first_entities": _SPANS_SQL + "SELECT doc_id, rank, text, kind FROM firsts",
    "collected_entities": _SPANS_SQL + """SELECT doc_id, coalesce(array_to_string(
        list(entity || '/' || kind ORDER BY rank) FILTER (entity IS NOT NULL), ','), '') AS entities
        FROM documents LEFT JOIN (SELECT doc_id, rank, text AS entity, kind FROM firsts) USING (doc_id) GROUP BY doc_id""",
}
