"""Queries over the given tables, one or more for each operator, and the same in SQL.

Documents stand for articles (their lines are numbered), benchmark items for
claims whose gold articles are the documents that contain them, embeddings for
points whose gold is their label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vectors as V
from .operators import chunkers, metrics, prompts, retrieval, sampling, stats
from .protocols import HashedEmbedder, RuleSegmenter
from .sources import collections

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

KS = (1, 3, 5, 10, 20)
_CLEAN = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
# documents with cleaned text and sentences
_PREPARED = f"""docs AS (SELECT doc_id::VARCHAR AS article_id, {_CLEAN.format('text')} AS clean,
    list_filter(list_transform(string_split(trim(text, ' ' || chr(10) || chr(9) || chr(13)), chr(10)), lambda s: {_CLEAN.format('s')}), lambda s: s <> '') AS sentences
    FROM documents)"""
_SENTENCES = f"""{_PREPARED}, sents AS (SELECT article_id, clean, generate_subscripts(sentences, 1) - 1 AS i, unnest(sentences) AS text FROM docs WHERE clean <> '')"""
_TOKENS = "len(list_filter(string_split({0}, ' '), lambda t: t <> ''))"


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all tasks at once, if its files are so small that they make fewer partitions (a file of
    one row group is one task's work)."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def articles(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda s, i: F.concat(i.cast("string"), F.lit("\t"), s)), "\n")
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("id"), "text", lines.alias("lines"))


def joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# --- projections, predicates ----------------------------------------------------------------


@query(f"SELECT doc_id, {_CLEAN.format('text')} AS clean FROM documents")
def text_clean_ws(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", T.clean(F.col("text"), entities=False).alias("clean"))


@query()
def text_clean_full(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.clean(F.col("html")).alias("clean"))


@query("SELECT page_id, NOT (" + " OR ".join(f"contains(html, '{a}')" for a in T.ARTIFACTS) + ") AS clean FROM pages")
def text_validate(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.validate(F.col("html")).alias("clean"))


_FLAGS = " UNION ALL ".join(f"SELECT '{a}' AS artifact, count(*) FILTER (contains(html, '{a}')) AS articles, round(100.0 * avg(contains(html, '{a}')::INT), 6) AS percentage FROM pages" for a in ("&amp;", "&quot;", *T.PROFILED))


@query(_FLAGS)
def text_artifact_counts(spark, sf):
    return stats.artifacts(table(spark, sf, "pages"), F.col("html"), ("&amp;", "&quot;", *T.PROFILED)).withColumn("percentage", F.round("percentage", 6))


@query("SELECT token, count(*) AS count FROM (SELECT unnest(regexp_extract_all(html, '&[a-zA-Z]+;')) AS token FROM pages) GROUP BY token ORDER BY count DESC, token LIMIT 20")
def pattern_top20(spark, sf):
    return stats.pattern_top(table(spark, sf, "pages"), F.col("html"), "&[a-zA-Z]+;")


@query("SELECT token, count(*) AS count FROM (SELECT unnest(regexp_extract_all(replace(replace(html, '<p>', '-LRB-'), '</p>', '-RRB-'), '-[A-Z]+-')) AS token FROM pages) GROUP BY token ORDER BY count DESC, token LIMIT 20")
def pattern_brackets_top20(spark, sf):
    # pages hold no brackets in words; paragraphs stand for them
    text = F.replace(F.replace("html", F.lit("<p>"), F.lit("-LRB-")), F.lit("</p>"), F.lit("-RRB-"))
    return stats.pattern_top(table(spark, sf, "pages"), text, "-[A-Z]+-")


@query(f"WITH {_SENTENCES} SELECT article_id, i::BIGINT AS sentence_id, text FROM sents")
def parse_lines(spark, sf):
    df = chunkers.prepared(articles(spark, sf), entities=False)
    return df.select("article_id", F.posexplode("sentences").alias("sentence_id", "text")).withColumn("sentence_id", F.col("sentence_id").cast("long"))


@query("""SELECT doc_id::VARCHAR AS id, x.i::VARCHAR AS line_num, x.s AS sentence, 0::BIGINT AS n_entities FROM
    (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda s, i: {i: i - 1, s: s}), lambda x: true)) AS x FROM documents)""")
def parse_lines_field(spark, sf):
    df = articles(spark, sf).select("id", F.explode(T.annotated_lines(F.col("lines"))).alias("l"))
    return df.select("id", "l.line_num", "l.sentence", F.size("l.entities").cast("long").alias("n_entities"))


@query("SELECT item_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS shown FROM benchmark")
def truncate_text(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.truncate(F.col("text"), 100).alias("shown"))


@query("""SELECT conv_id, turn, CASE WHEN contains(upper(text), 'SUPPORTS') THEN 'SUPPORTS' WHEN contains(upper(text), 'REFUTES') THEN 'REFUTES' ELSE 'NOT ENOUGH INFO' END AS label FROM conversations""")
def label_parse(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.parse_label(F.col("text")).alias("label"))


@query("""WITH s AS (SELECT DISTINCT source FROM documents),
    m AS (SELECT 'x/' || source || '-MiniLM-L6' AS model FROM s UNION ALL SELECT 'y/' || source || '-v2' FROM s
        UNION ALL SELECT 'multi-qa-lab/' || source || '-v1' FROM s UNION ALL SELECT 'multi-qa-lab/' || source || '-mpnet' FROM s)
    SELECT model, CASE WHEN lower(model) LIKE '%minilm%' THEN 'minilm' WHEN lower(model) LIKE '%mpnet%' THEN 'mpnet' WHEN lower(model) LIKE '%multi-qa%' THEN 'multiqa'
        ELSE lower(split_part(split_part(model, '/', 2), '-', 1)) END || '_sentence_chunks' AS name FROM m""")
def collection_names(spark, sf):
    s = table(spark, sf, "documents").select("source").distinct()
    forms = (("x/", "-MiniLM-L6"), ("y/", "-v2"), ("multi-qa-lab/", "-v1"), ("multi-qa-lab/", "-mpnet"))
    models = s.select(F.explode(F.array(*(F.concat(F.lit(a), "source", F.lit(b)) for a, b in forms))).alias("model"))
    return models.select("model", collections.name_column(F.col("model"), F.lit("sentence")).alias("name"))


@query(f"SELECT doc_id, {_CLEAN.format('text')} <> '' AS cleaned FROM documents")
def cleaned_flag(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (T.clean(F.col("text"), entities=False) != "").alias("cleaned"))


def _claims(spark, sf):
    """benchmark items as claims with nested evidence made of the documents of equal id."""
    b = table(spark, sf, "benchmark")
    four = F.array(F.lit("1"), F.lit("2"), F.concat(F.lit("D"), F.col("item_id").cast("string")), F.lit("0"))
    two = F.array(F.concat(F.lit("E"), (F.col("item_id") % 7).cast("string")), F.lit("3"))
    return b.select(F.col("item_id").alias("id"), F.col("text").alias("claim"), F.array(F.array(four, two), F.array(two)).alias("evidence"))


@query("SELECT item_id AS id, unnest(['D' || item_id, 'E' || item_id % 7]) AS article_id FROM benchmark")
def evidence_articles(spark, sf):
    return _claims(spark, sf).select("id", F.explode(T.evidence_articles(F.col("evidence"))).alias("article_id"))


@query("SELECT DISTINCT 'd' || item_id AS id FROM benchmark")
def evidence_required_ids(spark, sf):
    return sampling.required_ids(_claims(spark, sf))


@query("SELECT count(*) AS references, count(DISTINCT item_id) AS ids FROM benchmark")
def evidence_reference_counts(spark, sf):
    return sampling.reference_counts(_claims(spark, sf))


@query("SELECT count(*) AS claims, (count(DISTINCT item_id) + max((item_id % 5 = 2)::INT))::BIGINT AS ids FROM benchmark WHERE item_id % 3 <> 0")
def verifiable_counts(spark, sf):
    # every fifth item's evidence names no article, every third item isn't verifiable
    third = F.when(F.col("id") % 5 == 2, F.lit(None)).otherwise(F.col("evidence")[0][0][2])
    item = F.array(F.lit("1"), F.lit("2"), third)
    both = F.array(item, F.array(F.lit("1"), F.lit("2"), F.concat(F.lit("D"), F.col("id").cast("string"))))
    state = F.when(F.col("id") % 3 != 0, "VERIFIABLE").otherwise("NOT VERIFIABLE")
    return sampling.verifiable_counts(_claims(spark, sf).select("id", F.array(both).alias("evidence"), state.alias("verifiable")))


# --- chunkers -------------------------------------------------------------------------------


@query(f"WITH {_SENTENCES} SELECT article_id, i::BIGINT AS chunk_index, text, i::VARCHAR AS sentence_ids FROM sents")
def chunk_sentence(spark, sf):
    return chunkers.sentence(articles(spark, sf), entities=False).select("article_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text", joined("sentence_ids").alias("sentence_ids"))


@query(f"WITH {_SENTENCES} SELECT article_id, i::BIGINT AS chunk_index, 'sentence' AS chunk_type, length(text) AS chunk_size, {_TOKENS.format('text')} AS token_count, text <> '' AS cleaned FROM sents")
def chunk_sentence_meta(spark, sf):
    df = chunkers.with_metadata(chunkers.sentence(articles(spark, sf), entities=False), "sentence")
    return df.select("article_id", *(F.col(c).cast("long").alias(c) for c in ("chunk_index", "chunk_size", "token_count")), "chunk_type", "cleaned")


_CHARS = f"""{_PREPARED}, raw AS (SELECT article_id, clean, sentences, unnest(generate_series(0, length(clean) - 1, 450)) AS s FROM docs WHERE clean <> ''),
    chunks AS (SELECT article_id, clean, s, row_number() OVER (PARTITION BY article_id ORDER BY s) - 1 AS chunk_index, trim(substr(clean, s + 1, 500)) AS text FROM raw WHERE trim(substr(clean, s + 1, 500)) <> '')"""


@query(f"WITH {_CHARS} SELECT article_id, chunk_index, text FROM chunks")
def chunk_fixed_char(spark, sf):
    return chunkers.fixed_char(articles(spark, sf), entities=False).select("article_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


@query(f"""WITH {_SENTENCES}, spots AS (SELECT article_id, i, sum(length(text) + 1) OVER (PARTITION BY article_id ORDER BY i) - length(text) - 1 AS s, length(text) AS n FROM sents),
    raw AS{_CHARS.split(', raw AS', 1)[1]} SELECT c.article_id, c.chunk_index, c.text, string_agg(a.i::VARCHAR, ',' ORDER BY a.i) AS sentence_ids
    FROM chunks c JOIN spots a ON a.article_id = c.article_id AND a.s < c.s + 500 AND a.s + a.n > c.s GROUP BY ALL""")
def chunk_fixed_char_sentence_ids(spark, sf):
    return chunkers.fixed_char(articles(spark, sf), entities=False).select("article_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text", joined("sentence_ids").alias("sentence_ids"))


@query(f"""WITH {_PREPARED}, toks AS (SELECT article_id, string_split(clean, ' ') AS t FROM docs WHERE clean <> ''),
    raw AS (SELECT article_id, t, unnest(generate_series(0, len(t) - 1, 108)) AS s FROM toks)
    SELECT article_id, row_number() OVER (PARTITION BY article_id ORDER BY s) - 1 AS chunk_index, array_to_string(t[s + 1 : s + 128], ' ') AS text FROM raw""")
def chunk_fixed_token(spark, sf):
    return chunkers.fixed_token(articles(spark, sf), entities=False).select("article_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


# units of the rule that SQL can express: one unit for each sentence
_EDUS = f"""{_PREPARED}, units AS (SELECT article_id, list_filter(list_transform(sentences, lambda s, i: {{t: s, i: i - 1}}), lambda x: length(x.t) > 1) AS u FROM docs WHERE clean <> '')"""


class WholeSentences:
    """A segmenter that never cuts."""

    def boundaries(self, line: str) -> list[int]:
        return []


@query(f"""WITH {_EDUS}, raw AS (SELECT article_id, u, unnest(generate_series(0, len(u) - 1, 3)) AS s FROM units WHERE len(u) > 0)
    SELECT article_id, row_number() OVER (PARTITION BY article_id ORDER BY s) - 1 AS chunk_index, array_to_string(list_transform(u[s + 1 : s + 5], lambda x: x.t), ' ') AS text,
    array_to_string(list_transform(u[s + 1 : s + 5], lambda x: x.i), ',') AS sentence_ids FROM raw""")
def chunk_edu_windows(spark, sf):
    df = chunkers.custom_edu(articles(spark, sf), segmenter=WholeSentences, entities=False)
    return df.select("article_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text", joined("sentence_ids").alias("sentence_ids"))


# units of the default rule: they begin after , ; : or before a connective that isn't the last token
_CONNECTIVES = ", ".join(f"'{c}'" for c in RuleSegmenter.CONNECTIVES)
_RULES = f"""{_SENTENCES}, words AS (SELECT article_id, i, unnest(string_split(text, ' ')) AS t, generate_subscripts(string_split(text, ' '), 1) AS k, len(string_split(text, ' ')) AS n
        FROM sents WHERE length(text) > 1),
    cuts AS (SELECT *, k > 1 AND (regexp_matches(lag(t) OVER (PARTITION BY article_id, i ORDER BY k), '[,;:]$') OR (k < n AND t IN ({_CONNECTIVES}))) AS cut FROM words),
    numbered AS (SELECT *, sum(cut::INT) OVER (PARTITION BY article_id, i ORDER BY k) AS u FROM cuts),
    units AS (SELECT article_id, i, u, string_agg(t, ' ' ORDER BY k) AS text FROM numbered GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY i, u) - 1 AS place, count(*) OVER (PARTITION BY article_id) AS n FROM units),
    starts AS (SELECT article_id, n, unnest(generate_series(0, n - 1, 3)) AS s FROM (SELECT DISTINCT article_id, n FROM placed)),
    windows AS (SELECT article_id, s // 3 AS chunk_index, string_agg(text, ' ' ORDER BY place) AS text, array_to_string(list_sort(list_distinct(list(i))), ',') AS sentence_ids, count(*) AS units
        FROM starts JOIN placed USING (article_id) WHERE place >= s AND place < s + 5 GROUP BY article_id, s)"""


@query(f"WITH {_RULES} SELECT article_id, chunk_index::BIGINT AS chunk_index, text, sentence_ids FROM windows")
def chunk_edu_rules(spark, sf):
    df = chunkers.custom_edu(articles(spark, sf), entities=False)
    return df.select("article_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text", joined("sentence_ids").alias("sentence_ids"))


def _predictions(spark, sf):
    """Token predictions of overlapping windows: 1 where a token ends in a comma, seen by the window's second half only."""
    toks = T.materialised(table(spark, sf, "documents"), doc_id=F.col("doc_id"), tokens=T.tokens(F.col("text")))
    toks = toks.select("doc_id", chunkers.token_windows(F.col("tokens"), 34, 16).alias("w"))
    rows = toks.select("doc_id", F.explode("w").alias("w")).select("doc_id", F.col("w.start").alias("start"), F.posexplode("w.tokens").alias("at", "t"))
    return rows.select("doc_id", (F.col("start") + F.col("at")).cast("long").alias("pos"), (F.col("t").endswith(",") & (F.col("at") >= 16)).cast("int").alias("pred"))


_VOTES = """WITH toks AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS t FROM documents),
    w AS (SELECT doc_id, t, unnest(generate_series(0, greatest(ceil((len(t) - 32) / 16.0), 0)::BIGINT)) * 16 AS s FROM toks),
    p AS (SELECT doc_id, s, unnest(generate_series(s, least(s + 32, len(t)) - 1)) AS pos, t FROM w),
    votes AS (SELECT doc_id, pos, (t[pos + 1] LIKE '%,' AND pos - s >= 16)::INT AS pred FROM p)
    SELECT doc_id, pos, {} AS pred FROM votes GROUP BY doc_id, pos"""


@query(_VOTES.format("max(pred)"))
def token_vote(spark, sf):
    return chunkers.token_votes(_predictions(spark, sf), "max").select("doc_id", "pos", "pred")


@query(_VOTES.format("(sum(pred) > count(*) - sum(pred))::INT"))
def token_vote_majority(spark, sf):
    return chunkers.token_votes(_predictions(spark, sf), "vote").select("doc_id", "pos", "pred")


# --- statistics -----------------------------------------------------------------------------

_BLOCK = "round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v)::DOUBLE AS min, max(v)::DOUBLE AS max, round(median(v), 6) AS median, count(v) AS count"


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"""WITH {_SENTENCES}, m AS (SELECT 'chunk_characters' AS metric, length(text)::DOUBLE AS v FROM sents UNION ALL SELECT 'chunk_tokens', {_TOKENS.format('text')} FROM sents UNION ALL SELECT 'sentences_per_chunk', 1 FROM sents)
    SELECT metric, {_BLOCK} FROM m GROUP BY metric""")
def chunk_stats(spark, sf):
    return _rounded(stats.chunk_stats(chunkers.sentence(articles(spark, sf), entities=False)))


@query(f"""WITH {_SENTENCES}, m AS (SELECT 'sentence_characters' AS metric, length(text)::DOUBLE AS v FROM sents UNION ALL SELECT 'sentence_tokens', {_TOKENS.format('text')} FROM sents)
    SELECT metric, {_BLOCK} FROM m GROUP BY metric""")
def sentence_stats(spark, sf):
    return _rounded(stats.sentence_stats(chunkers.sentence(articles(spark, sf), entities=False)))


@query(f"""WITH {_RULES}, m AS (SELECT 'edu_characters' AS metric, length(text)::DOUBLE AS v FROM units UNION ALL SELECT 'edu_tokens', {_TOKENS.format('text')} FROM units
        UNION ALL SELECT 'edus_per_sentence', count(*) FROM units GROUP BY article_id, i)
    SELECT metric, {_BLOCK} FROM m GROUP BY metric""")
def edu_stats(spark, sf):
    return _rounded(stats.edu_stats(chunkers.edus(articles(spark, sf), entities=False)))


@query(f"WITH {_RULES}, m AS (SELECT 'edus_per_chunk' AS metric, units::DOUBLE AS v FROM windows) SELECT metric, {_BLOCK} FROM m GROUP BY metric")
def edus_per_chunk(spark, sf):
    return _rounded(stats.edus_per_chunk(chunkers.edus(articles(spark, sf), entities=False)))


@query(f"WITH {_RULES}, per AS (SELECT count(*) AS n FROM units GROUP BY article_id, i) SELECT count(*) FILTER (n > 1) AS count, round(100.0 * avg((n > 1)::INT), 6) AS percentage FROM per")
def multi_edu_pct(spark, sf):
    return _rounded(stats.multiple_edus(chunkers.edus(articles(spark, sf), entities=False)))


@query(_VOTES.split("SELECT doc_id, pos, {}")[0] + "SELECT sum(pred)::BIGINT AS boundaries, count(*) AS tokens FROM (SELECT max(pred) AS pred FROM votes GROUP BY doc_id, pos)")
def edu_boundary_total(spark, sf):
    return chunkers.predicted_boundaries(chunkers.token_votes(_predictions(spark, sf), "max"))


@query(f"WITH {_SENTENCES} SELECT count(DISTINCT article_id) AS articles, count(*) AS chunks, count(*) FILTER (trim(text) = '') AS cleaning_issues FROM sents")
def ingest_totals(spark, sf):
    return stats.ingested(chunkers.with_metadata(chunkers.sentence(articles(spark, sf), entities=False), "sentence"))


def _profile(spark, sf):
    n = F.size(F.filter(F.split("text", "\n"), lambda s: s != ""))
    return table(spark, sf, "documents").select("doc_id", "text", n.alias("sentences"), F.length("text").alias("chars"))


_PROFILE = "p AS (SELECT doc_id, text, len(list_filter(string_split(text, chr(10)), lambda s: s <> '')) AS sentences, length(text) AS chars FROM documents)"


@query(f"WITH {_PROFILE}, m AS (SELECT 'sentences' AS metric, sentences::DOUBLE AS v FROM p UNION ALL SELECT 'characters', chars FROM p) SELECT metric, {_BLOCK} FROM m GROUP BY metric")
def corpus_profile(spark, sf):
    return _rounded(stats.blocks(_profile(spark, sf), {"sentences": F.col("sentences"), "characters": F.col("chars")}))


# lines with a comma name an entity
@query("""WITH l AS (SELECT len(list_filter(string_split(text, chr(10)), lambda s: contains(s, ','))) > 0 AS linked FROM documents)
    SELECT count(*) FILTER (linked) AS articles, round(100.0 * avg(linked::INT), 6) AS percentage FROM l""")
def entity_links(spark, sf):
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.concat(i.cast("string"), F.lit("\t"), s, F.when(F.contains(s, F.lit(",")), "\tE").otherwise("")))
    return _rounded(stats.entity_links(table(spark, sf, "documents"), F.array_join(lines, "\n")))


@query(f"WITH {_PROFILE} SELECT q AS share, round(quantile_cont(chars, q), 6) AS value FROM p, (SELECT unnest([0.25, 0.5, 0.75, 0.9, 0.95])::DOUBLE AS q) GROUP BY q".replace("quantile_cont(chars, q)", "CASE q " + " ".join(f"WHEN {x} THEN quantile_cont(chars, {x})" for x in (0.25, 0.5, 0.75, 0.9, 0.95)) + " END"))
def percentiles(spark, sf):
    return _rounded(stats.percentiles(_profile(spark, sf), F.col("chars")))


@query(f"""WITH {_PROFILE}, e AS (SELECT min(chars)::DOUBLE AS lo, max(chars)::DOUBLE AS hi FROM p)
    SELECT CASE WHEN hi > lo THEN least(floor((chars - lo) / (hi - lo) * 50), 49) ELSE 0 END::BIGINT AS bin, count(*) AS count FROM p, e GROUP BY 1""")
def histogram50(spark, sf):
    return stats.histogram(_profile(spark, sf), F.col("chars"))


@query(f"WITH {_PROFILE} SELECT count(*) FILTER (sentences < 3) AS very_short, count(*) FILTER (sentences > 200) AS very_long, count(*) FILTER (trim(text) = '') AS empty_lines FROM p")
def edge_cases(spark, sf):
    return stats.edge_cases(_profile(spark, sf), F.col("sentences"), F.col("text"))


@query("""WITH n AS (SELECT len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS n FROM documents)
    SELECT count(*) FILTER (n > 512) AS over, round(100.0 * avg((n > 512)::INT), 6) AS percentage, round(avg(n), 6) AS mean, max(n)::BIGINT AS most FROM n""")
def token_overflow(spark, sf):
    return _rounded(stats.overflow(table(spark, sf, "documents"), F.size(T.tokens(F.col("text"))))).withColumn("most", F.col("most").cast("long"))


@query("SELECT round(avg(value) FILTER (a <= 10), 6) AS first, round(avg(value) FILTER (b <= 10), 6) AS last, round(avg(value) FILTER (b <= 10) / avg(value) FILTER (a <= 10), 6) AS slowdown FROM (SELECT value, row_number() OVER (ORDER BY event_id) AS a, row_number() OVER (ORDER BY event_id DESC) AS b FROM events)")
def batch_slowdown(spark, sf):
    return _rounded(stats.slowdown(table(spark, sf, "events"), "event_id", "value"))


# --- vectors --------------------------------------------------------------------------------


@query("""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS t FROM documents),
    c AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 7))::BIGINT % 256 AS bucket, count(*) AS n FROM t GROUP BY ALL)
    SELECT doc_id, bucket, n, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS w FROM c""")
def hash_embed(spark, sf):
    return retrieval.hashed_weights(table(spark, sf, "documents"), "doc_id", F.col("text")).withColumn("w", F.round("w", 6))


def _points(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("label").cast("string").alias("article_id"), F.col("embedding").alias("vector")).repartition(spark.sparkContext.defaultParallelism)


def _asked(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("claim_id"), F.col("embedding").alias("vector"))


_SCORED = """q AS (SELECT vec_id AS claim_id, embedding::DOUBLE[] AS q, label AS gold FROM embeddings WHERE vec_id % 50 = 0),
    p AS (SELECT vec_id AS point_id, label::VARCHAR AS article_id, embedding::DOUBLE[] AS v FROM embeddings),
    scored AS (SELECT claim_id, point_id, article_id, list_dot_product(q, v) / sqrt(list_dot_product(q, q) * list_dot_product(v, v)) AS score FROM q, p {}),
    hits AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, point_id) AS rank FROM scored)"""


def _hits(spark, sf, config=None, **kw):
    return retrieval.search(_points(spark, sf), _asked(spark, sf), config or retrieval.RetrievalConfig(k=20), **kw)


def _shown(hits):
    return hits.select("claim_id", F.col("rank").cast("long").alias("rank"), "point_id", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORED.format('')} SELECT claim_id, rank, point_id, round(score, 6) AS score FROM hits WHERE rank <= 20")
def knn_topk(spark, sf):
    return _shown(_hits(spark, sf))


@query(f"WITH {_SCORED.format('')} SELECT claim_id, rank, point_id, round(score, 6) AS score FROM hits WHERE rank <= 5")
def knn_topk_native(spark, sf):
    return _shown(retrieval.search_native(_points(spark, sf), _asked(spark, sf), retrieval.RetrievalConfig(k=5)))


@query(f"WITH {_SCORED.format('')}, r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, point_id) AS rk FROM scored WHERE score >= 0.3) SELECT claim_id, rk AS rank, point_id, round(score, 6) AS score FROM r WHERE rk <= 100")
def knn_threshold(spark, sf):
    return _shown(_hits(spark, sf, retrieval.RetrievalConfig("threshold", threshold=0.3)))


@query(f"WITH {_SCORED.format(chr(10) + '    WHERE article_id IN (' + repr('1') + ', ' + repr('4') + ')')} SELECT claim_id, rank, point_id, round(score, 6) AS score FROM hits WHERE rank <= 20")
def knn_filtered(spark, sf):
    return _shown(_hits(spark, sf, where=F.col("article_id").isin("1", "4")))


@query(f"WITH {_SCORED.format('')} SELECT claim_id, count(*) AS chunks, count(DISTINCT article_id) AS articles, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score FROM hits WHERE rank <= 20 GROUP BY claim_id")
def knn_scores_summary(spark, sf):
    return _rounded(retrieval.summary(_hits(spark, sf)))


@query(f"WITH {_SCORED.format('')}, a AS (SELECT claim_id, article_id, min(rank) AS f FROM hits WHERE rank <= 20 GROUP BY ALL) SELECT claim_id, article_id, row_number() OVER (PARTITION BY claim_id ORDER BY f) AS rank FROM a")
def dedup_ranked_articles(spark, sf):
    return retrieval.ranked_articles(_hits(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_SENTENCES} SELECT row_number() OVER (ORDER BY article_id, i) - 1 AS point_id, article_id, i::BIGINT AS chunk_index FROM sents")
def point_ids(spark, sf):
    return collections.numbered(chunkers.sentence(articles(spark, sf), entities=False)).select(F.col("point_id").cast("long").alias("point_id"), "article_id", F.col("chunk_index").cast("long").alias("chunk_index"))


@query(f"WITH {_SENTENCES} SELECT i::BIGINT AS chunk_index, text FROM sents WHERE article_id = '7' ORDER BY i LIMIT 100")
def scroll_article(spark, sf):
    points = chunkers.sentence(articles(spark, sf), entities=False).withColumn("point_id", F.col("chunk_index"))
    return retrieval.article_chunks(points, "7").select(F.col("chunk_index").cast("long").alias("chunk_index"), "text")


@query(f"WITH {_SENTENCES} SELECT article_id, i::BIGINT AS chunk_index, text, 'hashed' AS embedding_model, 'sentence' AS chunking_method FROM sents")
def payload_project(spark, sf):
    df = collections.enriched(chunkers.sentence(articles(spark, sf), entities=False), "hashed", "sentence")
    return df.select("article_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text", "embedding_model", "chunking_method")


# --- evaluation -----------------------------------------------------------------------------


def _gold_labels(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("claim_id"), F.col("label").cast("string").alias("article_id"))


_RANKED = f"""{_SCORED.format('')}, a AS (SELECT claim_id, article_id, min(rank) AS f FROM hits WHERE rank <= 20 GROUP BY ALL),
    ranked AS (SELECT claim_id, article_id, row_number() OVER (PARTITION BY claim_id ORDER BY f) AS rank FROM a),
    gold AS (SELECT claim_id, gold::VARCHAR AS article_id FROM q)"""
_AT_K = """ks AS (SELECT unnest([1, 3, 5, 10, 20]) AS k), g AS (SELECT claim_id, count(*) AS gold FROM gold GROUP BY 1),
    at_k AS (SELECT g.claim_id, k, count(r.rank) AS tp, count(r.rank) / k AS precision, count(r.rank) / any_value(gold) AS recall, (count(r.rank) > 0)::INT AS accuracy
    FROM g CROSS JOIN ks LEFT JOIN (SELECT r.claim_id, r.rank FROM ranked r JOIN gold USING (claim_id, article_id)) r ON r.claim_id = g.claim_id AND r.rank <= k GROUP BY g.claim_id, k),
    rr AS (SELECT g.claim_id, coalesce(1.0 / min(r.rank), 0)::DOUBLE AS rr FROM g LEFT JOIN (SELECT r.claim_id, r.rank FROM ranked r JOIN gold USING (claim_id, article_id)) r ON r.claim_id = g.claim_id GROUP BY 1)"""


@query(f"WITH {_RANKED}, {_AT_K} SELECT claim_id, k, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, accuracy FROM at_k")
def metrics_at_k(spark, sf):
    return _rounded(metrics.at_k(retrieval.ranked_articles(_hits(spark, sf)), _gold_labels(spark, sf)))


@query(f"WITH {_RANKED}, {_AT_K} SELECT claim_id, round(rr, 6) AS rr FROM rr")
def mrr(spark, sf):
    return _rounded(metrics.reciprocal_rank(retrieval.ranked_articles(_hits(spark, sf)), _gold_labels(spark, sf)))


@query(f"WITH {_RANKED}, {_AT_K} SELECT k, count(*) AS claims, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(accuracy), 6) AS accuracy FROM at_k GROUP BY k")
def eval_summary(spark, sf):
    return _rounded(metrics.averages(metrics.at_k(retrieval.ranked_articles(_hits(spark, sf)), _gold_labels(spark, sf))))


def _contained(spark, sf):
    """claim_id, article_id: documents that contain a benchmark item. The words of an item but the
    first and the last are whole words of any text that holds it: items and texts meet in the
    longest of these. Items without such words meet texts in their first three characters. Where
    they meet, texts are searched."""
    items = table(spark, sf, "benchmark").where("length(text) > 0").select(F.col("item_id").alias("claim_id"), F.col("text").alias("item"))
    docs = spread(table(spark, sf, "documents").select("doc_id", "text").where("text IS NOT NULL"))
    inner = F.slice("t", 2, F.greatest(F.size("t") - 2, F.lit(0)))
    keyed = T.materialised(items.withColumn("t", T.tokens(F.col("item"))), claim_id=F.col("claim_id"), item=F.col("item"), inner=inner)
    longest = F.array_max(F.transform("inner", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    wide = keyed.where(F.size("inner") > 0).select("claim_id", "item", longest.alias("key"))
    short = keyed.where(F.size("inner") == 0).select("claim_id", "item", F.substring("item", 1, 3).alias("key"))
    met = docs.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("key")).join(wide, "key").select("doc_id", "claim_id", "item")
    if not short.isEmpty():
        parts = F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), lambda i: F.substr("text", i, n))))
        met = met.unionByName(docs.select("doc_id", F.explode(F.array_distinct(parts)).alias("key")).join(short, "key").select("doc_id", "claim_id", "item"))
    return met.distinct().join(docs, "doc_id").where(F.contains("text", F.col("item"))).select("claim_id", F.col("doc_id").cast("string").alias("article_id"))


_GOLD = "gold AS (SELECT item_id AS claim_id, doc_id::VARCHAR AS article_id FROM benchmark b, documents d WHERE length(b.text) > 0 AND contains(d.text, b.text))"


@query(f"WITH {_GOLD} SELECT claim_id, article_id FROM gold")
def gold_from_containment(spark, sf):
    return _contained(spark, sf)


_DOC_HITS = f"""{_CHARS}, {_GOLD}, pts AS (SELECT row_number() OVER (ORDER BY article_id, chunk_index) - 1 AS point_id, article_id, text FROM chunks),
    pt AS (SELECT point_id, unnest(list_filter(string_split(lower(text), ' '), lambda t: t <> '')) AS t FROM pts),
    pc AS (SELECT point_id, ('0x' || substr(md5(t), 1, 7))::BIGINT % 256 AS b, count(*) AS n FROM pt GROUP BY ALL),
    pw AS (SELECT point_id, b, n / sqrt(sum(n * n) OVER (PARTITION BY point_id)) AS w FROM pc),
    ct AS (SELECT item_id AS claim_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS t FROM benchmark WHERE item_id IN (SELECT claim_id FROM gold)),
    cc AS (SELECT claim_id, ('0x' || substr(md5(t), 1, 7))::BIGINT % 256 AS b, count(*) AS n FROM ct GROUP BY ALL),
    cw AS (SELECT claim_id, b, n / sqrt(sum(n * n) OVER (PARTITION BY claim_id)) AS w FROM cc),
    scored AS (SELECT claim_id, point_id, round(sum(cw.w * pw.w), 9) AS score FROM cw JOIN pw USING (b) GROUP BY ALL),
    hits AS (SELECT s.*, article_id, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, point_id) AS rank FROM scored s JOIN pts USING (point_id)),
    a AS (SELECT claim_id, article_id, min(rank) AS f FROM hits WHERE rank <= 20 GROUP BY ALL),
    ranked AS (SELECT claim_id, article_id, row_number() OVER (PARTITION BY claim_id ORDER BY f) AS rank FROM a)"""


def _doc_hits(spark, sf):
    """The 20 nearest chunks (of 500 characters, hashed embeddings) of each claim with gold, and the gold."""
    gold = _contained(spark, sf).persist()  # what the claims, the ranking and the metrics need
    # points are known by article and place, which is also the order of their ids
    point = F.concat("article_id", F.lit("/"), F.lpad(F.col("chunk_index").cast("string"), 10, "0"))
    points = chunkers.fixed_char(articles(spark, sf), entities=False, sentence_ids=False).select(point.alias("point_id"), "article_id", "text")
    chosen = table(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim")).join(gold.select("claim_id").distinct(), "claim_id", "left_semi")
    claims = retrieval.embed(chosen, "claim", kind="double")
    return retrieval.search(points, claims, retrieval.RetrievalConfig(k=20), digits=9, embedder=HashedEmbedder), gold


@query(f"WITH {_DOC_HITS}, {_AT_K} SELECT k, count(*) AS claims, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(accuracy), 6) AS accuracy, (SELECT round(avg(rr), 6) FROM rr) AS mrr FROM at_k GROUP BY k")
def retrieval_docs_eval(spark, sf):
    hits, gold = _doc_hits(spark, sf)
    return _rounded(metrics.averages(metrics.judged(retrieval.ranked_articles(hits), gold)))


# --- labels, classification -----------------------------------------------------------------

_LABEL = "CASE quality + 2 * toxic WHEN 1 THEN 'SUPPORTS' WHEN 3 THEN 'REFUTES' ELSE 'NOT ENOUGH INFO' END"


def _labels(spark, sf):
    code = F.col("quality") + 2 * F.col("toxic")
    name = F.when(code == 1, "SUPPORTS").when(code == 3, "REFUTES").otherwise("NOT ENOUGH INFO")
    return table(spark, sf, "labels").select("doc_id", name.alias("label"))


@query(f"SELECT label, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM labels), 6) AS percentage FROM (SELECT {_LABEL} AS label FROM labels) GROUP BY label")
def label_distribution(spark, sf):
    return _rounded(stats.distribution(_labels(spark, sf), "label"))


@query(f"SELECT DISTINCT label, round(count(*) OVER (PARTITION BY label) / count(*) OVER (), 6) AS proportion FROM (SELECT {_LABEL} AS label FROM labels)")
def class_proportion(spark, sf):
    return stats.distribution(_labels(spark, sf), "label").select("label", F.round(F.col("percentage") / 100, 6).alias("proportion"))


def _judged(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.length("text") < 1000, "SUPPORTS").when(F.length("text") < 4000, "REFUTES").otherwise("NOT ENOUGH INFO").alias("predicted_label"))
    return _labels(spark, sf).withColumnRenamed("label", "true_label").join(docs, "doc_id")


_JUDGED = f"""j AS (SELECT {_LABEL} AS t, CASE WHEN length(text) < 1000 THEN 'SUPPORTS' WHEN length(text) < 4000 THEN 'REFUTES' ELSE 'NOT ENOUGH INFO' END AS p FROM labels JOIN documents USING (doc_id)),
    names AS (SELECT unnest(['SUPPORTS', 'REFUTES', 'NOT ENOUGH INFO']) AS label),
    c AS (SELECT label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (t = label) AS support, count(*) FILTER (p = label) AS predicted FROM j, names GROUP BY label),
    r AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM c),
    f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r)"""


@query(f"WITH {_JUDGED} SELECT round(avg((t = p)::INT), 6) AS accuracy, count(*) AS support FROM j")
def clf_accuracy(spark, sf):
    return _rounded(metrics.accuracy(_judged(spark, sf)))


@query(f"WITH {_JUDGED} SELECT label, tp, support, predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def clf_per_class(spark, sf):
    return _rounded(metrics.per_class(_judged(spark, sf)).drop("place"))


@query(f"WITH {_JUDGED} SELECT round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1, sum(support)::BIGINT AS support FROM f")
def clf_weighted_prf(spark, sf):
    return _rounded(metrics.weighted(_judged(spark, sf)))


@query(f"""WITH {_JUDGED} SELECT label AS true_label, count(p) FILTER (p = 'SUPPORTS') AS "SUPPORTS", count(p) FILTER (p = 'REFUTES') AS "REFUTES", count(p) FILTER (p = 'NOT ENOUGH INFO') AS "NOT ENOUGH INFO" FROM names LEFT JOIN j ON t = label GROUP BY label""")
def confusion_matrix(spark, sf):
    return metrics.confusion(_judged(spark, sf)).drop("place")


# --- sampling, sets -------------------------------------------------------------------------

_DRAW = "md5('42:' || {})"


@query(f"""WITH l AS (SELECT doc_id, {_LABEL} AS label, {_DRAW.format('doc_id')} AS d FROM labels),
    q AS (SELECT label, least(floor(100 * (count(*) / (SELECT count(*) FROM l))), count(*)) AS quota FROM l GROUP BY label),
    r AS (SELECT l.*, quota, row_number() OVER (PARTITION BY label ORDER BY d, doc_id) AS place FROM l JOIN q USING (label)),
    rest AS (SELECT doc_id, label FROM r WHERE place > quota ORDER BY d, doc_id LIMIT (SELECT greatest(0, 100 - sum(quota))::BIGINT FROM q))
    SELECT doc_id, label FROM r WHERE place <= quota UNION ALL SELECT doc_id, label FROM rest""")
def stratified_sample(spark, sf):
    return sampling.stratified(_labels(spark, sf), 100, "doc_id")


@query(f"SELECT doc_id, source FROM documents ORDER BY {_DRAW.format('doc_id')}, doc_id LIMIT 50")
def reservoir_sample(spark, sf):
    return sampling.simple(table(spark, sf, "documents").select("doc_id", "source"), 50, "doc_id")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_DRAW.format('doc_id')}, doc_id) AS place FROM labels")
def shuffle_rank(spark, sf):
    df = table(spark, sf, "labels").select("doc_id", sampling.draw("doc_id").alias("d"))
    # ranks of groups of the order first, so that no task sorts all rows
    df = df.withColumn("g", F.substring("d", 1, 2))
    base = df.groupBy("g").count().select("g", F.coalesce(F.sum("count").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("g").orderBy("d", "doc_id"))
    return df.withColumn("inside", inside).join(base, "g").select("doc_id", (F.col("base") + F.col("inside")).cast("long").alias("place"))


def _required(spark, sf):
    return table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))


_NEEDED = "SELECT doc_id FROM labels WHERE toxic = 1"


@query(f"SELECT doc_id, source FROM documents WHERE doc_id IN ({_NEEDED})")
def required_docs_semi(spark, sf):
    return sampling.matching(table(spark, sf, "documents").select("doc_id", "source"), _required(spark, sf), "doc_id")


@query(f"SELECT doc_id, source FROM documents WHERE doc_id NOT IN ({_NEEDED})")
def distractors_anti(spark, sf):
    return sampling.matching(table(spark, sf, "documents").select("doc_id", "source"), _required(spark, sf), "doc_id", "left_anti")


@query(f"""SELECT doc_id, source FROM documents WHERE doc_id IN ({_NEEDED}) UNION ALL
    SELECT * FROM (SELECT doc_id, source FROM documents WHERE doc_id NOT IN ({_NEEDED}) ORDER BY {_DRAW.format('doc_id')}, doc_id LIMIT 40)""")
def reduced_corpus(spark, sf):
    return sampling.reduced(table(spark, sf, "documents").select("doc_id", "source"), _required(spark, sf), 40, "doc_id")


@query(f"""SELECT count(*) AS required, count(d.doc_id) AS found, 100.0 * count(d.doc_id) / count(*) AS percentage FROM
    (SELECT DISTINCT item_id * 7 AS doc_id FROM benchmark) l LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d USING (doc_id)""".replace("100.0 * count(d.doc_id) / count(*)", "round(100.0 * count(d.doc_id) / count(*), 6)"))
def coverage(spark, sf):
    return _rounded(sampling.coverage(table(spark, sf, "documents"), table(spark, sf, "benchmark").select((F.col("item_id") * 7).cast("string").alias("id")), "doc_id"))


@query("SELECT doc_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id FROM labels WHERE toxic = 1")
def union_splits(spark, sf):
    df = table(spark, sf, "labels")
    return df.where("quality = 1").select("doc_id").unionByName(df.where("toxic = 1").select("doc_id"))


@query("SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def intersect_ids(spark, sf):
    df = table(spark, sf, "labels")
    return df.where("quality = 1").select("doc_id").intersect(df.where("toxic = 1").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id").exceptAll(table(spark, sf, "labels").select("doc_id")).distinct()


@query("SELECT DISTINCT source FROM documents")
def distinct_ids(spark, sf):
    return table(spark, sf, "documents").select("source").distinct()


@query(f"SELECT doc_id, label FROM (SELECT doc_id, {_LABEL} AS label, row_number() OVER (PARTITION BY {_LABEL} ORDER BY doc_id) AS r FROM labels) WHERE r <= 2")
def fewshot_examples(spark, sf):
    return sampling.first_of_each(_labels(spark, sf), 2, "doc_id", ("SUPPORTS", "REFUTES", "NOT ENOUGH INFO"))


# --- prompts --------------------------------------------------------------------------------


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(f"SELECT item_id AS claim_id, {_sql_text(prompts.HEADER + 'Claim: ')} || text || {_sql_text(chr(10) * 2 + 'Label:')} AS prompt FROM benchmark")
def prompt_build(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), prompts.prompt(F.col("text")).alias("prompt"))


_EVIDENCE = f"""{_DOC_HITS}, e AS (SELECT claim_id, string_agg('[Evidence ' || rank || '] (Source: ' || h.article_id || ', Relevance: ' || printf('%.3f', score) || ')' || chr(10) || p.text, chr(10) || chr(10) ORDER BY rank) AS evidence
        FROM hits h JOIN pts p USING (point_id) WHERE rank <= 3 GROUP BY 1)"""


@query(f"""WITH {_EVIDENCE} SELECT claim_id, {_sql_text(prompts.HEADER + 'Claim: ')} || text || {_sql_text(chr(10) * 2 + 'Evidence:' + chr(10))} || evidence || {_sql_text(chr(10) * 2 + 'Label:')} AS prompt FROM e JOIN benchmark ON item_id = claim_id""")
def prompt_with_evidence(spark, sf):
    hits, _ = _doc_hits(spark, sf)
    claims = table(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"))
    return claims.join(prompts.evidence_texts(hits, 3), "claim_id").select("claim_id", prompts.prompt(F.col("claim"), F.col("evidence")).alias("prompt"))


# the default generator: the share of the claim's different words that the rest of the prompt holds
@query(f"""WITH {_EVIDENCE}, c AS (SELECT item_id AS claim_id, lower(coalesce(evidence, {_sql_text(prompts.NOTHING_FOUND)}) || {_sql_text(chr(10) * 2 + 'Label:')}) AS found,
        list_distinct(list_filter(regexp_split_to_array(lower(string_split(text, chr(10))[1]), '\\s+'), lambda w: w <> '')) AS w FROM benchmark LEFT JOIN e ON item_id = claim_id),
    s AS (SELECT claim_id, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(found, x))) / len(w) ELSE 0 END AS share FROM c)
    SELECT claim_id, CASE WHEN share >= 0.8 THEN 'SUPPORTS' WHEN share >= 0.5 THEN 'REFUTES' ELSE 'NOT ENOUGH INFO' END AS predicted_label FROM s""")
def predict_claims(spark, sf):
    hits, _ = _doc_hits(spark, sf)
    claims = table(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"))
    return prompts.predict(claims, hits, most=3).select("claim_id", "predicted_label")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot FROM embeddings a, embeddings b WHERE b.vec_id = a.vec_id + 1")
def vector_dot(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")).join(e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("vb")), "a").select("a", "b", F.round(V.dot(F.col("va"), F.col("vb")), 6).alias("dot"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
