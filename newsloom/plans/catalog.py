"""Registered queries of the domain operators, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import lexicons as lex
from newsloom.functions import spans
from newsloom.functions import text as tx
from newsloom.operators import aggregates as agg
from newsloom.operators import alerts, changes, evaluation, features, graph, listing, merging, modelling, neardup, ranking, vectors, verdicts
from newsloom.plans.staging import stage
from newsloom.sources import domain
from newsloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {domain.VIEWS_SQL.strip()}\n{sql.strip()}"  # sql may go on with further views
        return function

    return register


def _in(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _any(column: str, terms: list[str]) -> str:
    return " + ".join(f"CASE WHEN contains({column}, '" + t.replace("'", "''") + "') THEN 1 ELSE 0 END" for t in terms)


_NOW = "(SELECT max(at_s) FROM ev)"
_TOKEN = tx.TOKEN.replace("'", "''")


def _now(spark: SparkSession, sf_dir: str) -> int:
    return domain.events(spark, sf_dir).agg(F.max("at_s")).first()[0] or 0


# ---------------------------------------------------------------- sources and sinks


@query("src_7_parquet_tables", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'pages', count(*) FROM pages")
def src_7(spark, sf_dir):
    parts = [domain.table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("documents", "events", "pages")]
    return parts[0].union(parts[1]).union(parts[2])


@query("snk_2_csv_safe_cells", r"SELECT page_id, regexp_replace(html, '^([=+\-@\t\r])', '''\1') AS cell FROM pages")
def snk_2(spark, sf_dir):
    return domain.table(spark, sf_dir, "pages").select("page_id", tx.csv_safe(F.col("html")).alias("cell"))


@query("snk_3_published_by_edges", "SELECT DISTINCT claim_id, domain FROM claims")
def snk_3(spark, sf_dir):
    return domain.claims(spark, sf_dir).select("claim_id", "domain").distinct()


@query("snk_5_from_domain_edges", "SELECT article_id, substr(title, 1, 300) AS title, domain FROM articles WHERE domain IS NOT NULL")
def snk_5(spark, sf_dir):
    return domain.articles(spark, sf_dir).where("domain is not null").select("article_id", F.substring("title", 1, 300).alias("title"), "domain")


# ---------------------------------------------------------------- scalar functions as table jobs


@query(
    "fn_1_clean_markup",
    r"""SELECT page_id, nullif(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t]*\n\s*', chr(10), 'g'), '[ \t]+', ' ', 'g')), '') AS cleaned FROM pages""",
)
def fn_1(spark, sf_dir):
    return domain.table(spark, sf_dir, "pages").select("page_id", tx.clean_markup(F.col("html")).alias("cleaned"))


@query("fn_2_display_text", r"SELECT page_id, nullif(substr(trim(regexp_replace(regexp_replace(html, '<[^a-z/!]|</?[a-z][^>]*>', ' ', 'g'), '\s+', ' ', 'g')), 1, 200), '') AS shown FROM pages")
def fn_2(spark, sf_dir):
    return domain.table(spark, sf_dir, "pages").select("page_id", tx.display_text(F.col("html"), 200).alias("shown"))


@query("fn_4_url_authority", r"SELECT page_id, nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1), '') AS authority FROM pages")
def fn_4(spark, sf_dir):
    return domain.table(spark, sf_dir, "pages").select("page_id", tx.url_authority(F.col("url")).alias("authority"))


@query("fn_5_canonical_host", r"SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', ''), '\.$', ''), '') AS host FROM pages")
def fn_5(spark, sf_dir):
    return domain.table(spark, sf_dir, "pages").select("page_id", tx.canonical_host(F.col("url")).alias("host"))


@query("fn_6_word_count", r"SELECT doc_id, CASE WHEN length(text) > 0 THEN CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) END AS n_words FROM documents")
def fn_6(spark, sf_dir):
    return domain.table(spark, sf_dir, "documents").select("doc_id", tx.word_count(F.col("text")).alias("n_words"))


@query("fn_8_content_hash", "SELECT article_id, content_hash FROM articles")
def fn_8(spark, sf_dir):
    return domain.articles(spark, sf_dir).select("article_id", "content_hash")


@query("fn_10_sentences", "SELECT claim_id, article_id, claim_text FROM claims")
def fn_10(spark, sf_dir):
    return domain.claims(spark, sf_dir).select("claim_id", "article_id", "claim_text")


@query("fn_11_claim_worthiness", "SELECT claim_id, confidence FROM claims WHERE confidence >= 0.5")
def fn_11(spark, sf_dir):
    return domain.claims(spark, sf_dir).where("confidence >= 0.5").select("claim_id", "confidence")


@query("fn_12_tokens", f"SELECT claim_id, array_to_string(regexp_extract_all(lower(claim_text), '{_TOKEN}'), ' ') AS tokens FROM claims")
def fn_12(spark, sf_dir):
    return domain.claims(spark, sf_dir).select("claim_id", F.array_join(tx.tokens(F.col("claim_text")), " ").alias("tokens"))


_COMMON = lex.STOP_WORDS + lex.HEDGE_WORDS + lex.POLARITY_WORDS + lex.ATTRIBUTION_WORDS + lex.SCOPE_WORDS


@query(
    "fn_13_entity_tokens",
    f"""SELECT claim_id, array_to_string(list_filter(regexp_extract_all(claim_text, '{_TOKEN}'),
    lambda t: regexp_matches(t, '^([A-Z][a-zA-Z]{{2,}}|[A-Z]{{2}})$') AND lower(t) NOT IN ({_in(_COMMON)})), ' ') AS entities FROM claims""",
)
def fn_13(spark, sf_dir):
    return domain.claims(spark, sf_dir).select("claim_id", F.array_join(tx.entity_tokens(F.col("claim_text")), " ").alias("entities"))


@query(
    "fn_14_lexicon_features",
    f"""SELECT claim_id, len(list_filter(t, lambda x: x IN ({_in(lex.POLARITY_WORDS)}))) AS polarity, len(list_filter(t, lambda x: x IN ({_in(lex.HEDGE_WORDS)}))) AS hedge,
    len(list_filter(t, lambda x: x IN ({_in(lex.ATTRIBUTION_WORDS)}))) AS attribution,
    len(list_filter(t, lambda x: x IN ({_in(lex.SCOPE_WORDS)}))) + {_any("j", [f" {p} " for p in lex.SCOPE_PHRASES])} AS scope,
    len(list_filter(t, lambda x: regexp_matches(x, '^[+\\-]?\\$?[0-9]'))) AS numbers
    FROM (SELECT claim_id, regexp_extract_all(lower(claim_text), '{_TOKEN}') AS t, ' ' || array_to_string(regexp_extract_all(lower(claim_text), '{_TOKEN}'), ' ') || ' ' AS j FROM claims)""",
)
def fn_14(spark, sf_dir):
    text = F.col("claim_text")
    sizes = {k: F.size(tx.lexicon_tokens(text, k)).cast("long").alias(k) for k in ("polarity", "hedge", "attribution", "scope")}
    return domain.claims(spark, sf_dir).select("claim_id", *sizes.values(), F.size(tx.numeric_tokens(text)).cast("long").alias("numbers"))


_SET = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_]+'))"


@query(
    "fn_17_lexical_jaccard",
    f"""SELECT from_id, to_id, CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE ELSE 0.0 END AS jaccard
    FROM (SELECT r.from_id, r.to_id, {_SET.format("a.claim_text")} AS x, {_SET.format("b.claim_text")} AS y FROM relations r JOIN claims a ON a.claim_id = r.from_id JOIN claims b ON b.claim_id = r.to_id)""",
)
def fn_17(spark, sf_dir):
    text = domain.claims(spark, sf_dir).select("claim_id", "claim_text")
    pairs = domain.relations(spark, sf_dir).select("from_id", "to_id")
    pairs = pairs.join(text.toDF("from_id", "x"), "from_id").join(text.toDF("to_id", "y"), "to_id")
    return pairs.select("from_id", "to_id", tx.jaccard(tx.token_set(F.col("x")), tx.token_set(F.col("y"))).alias("jaccard"))


@query("fn_21_identity_key", r"SELECT doc_id, CASE WHEN length(f) >= 80 THEN sha256(f) END AS key FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS f FROM documents)")
def fn_21(spark, sf_dir):
    return domain.table(spark, sf_dir, "documents").select("doc_id", tx.identity_key(F.col("text")).alias("key"))


@query("fn_22_pair_key", "SELECT from_id, to_id, least(from_id::VARCHAR, to_id::VARCHAR) || ':' || greatest(from_id::VARCHAR, to_id::VARCHAR) AS key FROM relations")
def fn_22(spark, sf_dir):
    return domain.relations(spark, sf_dir).select("from_id", "to_id", tx.pair_key(F.col("from_id"), F.col("to_id")).alias("key"))


@query(
    "fn_23_language_signal",
    rf"""SELECT claim_id, least(100, greatest(5, 85 - 12 * ({_any("lower(claim_text)", lex.HEDGE_TERMS)}) - 18 * ({_any("lower(claim_text)", lex.SENSATION_TERMS)})
    - CASE WHEN regexp_matches(lower(claim_text), '(^|[^\p{{L}}\p{{N}}_])(i|we|my|our|you)([^\p{{L}}\p{{N}}_]|$)') THEN 15 ELSE 0 END + CASE WHEN regexp_matches(claim_text, '[0-9]') THEN 5 ELSE 0 END
    - CASE WHEN len(regexp_extract_all(claim_text, '\S+')) < 6 THEN 10 ELSE 0 END)) / 100.0::DOUBLE AS signal FROM claims""",
)
def fn_23(spark, sf_dir):
    return domain.claims(spark, sf_dir).select("claim_id", tx.language_signal(F.col("claim_text")).alias("signal"))


@query("fn_25_json_value", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def fn_25(spark, sf_dir):
    return domain.events(spark, sf_dir).select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as double)").alias("k"))


@query("fn_27_similarity_bucket", "SELECT pair_id, CASE WHEN sim_score >= 0.95 THEN 'b95' WHEN sim_score >= 0.85 THEN 'b85' WHEN sim_score >= 0.75 THEN 'b75' WHEN sim_score >= 0.6 THEN 'b60' WHEN sim_score >= 0.4 THEN 'b40' ELSE 'b00' END AS bucket FROM eval_pairs")
def fn_27(spark, sf_dir):
    return domain.eval_pairs(spark, sf_dir).select("pair_id", tx.similarity_bucket(F.col("sim_score")).alias("bucket"))


@query("fn_29_one_line", r"SELECT page_id, substr(trim(regexp_replace(html, '\s+', ' ', 'g')), 1, 120) AS message FROM pages")
def fn_29(spark, sf_dir):
    return domain.table(spark, sf_dir, "pages").select("page_id", tx.one_line(F.col("html"), 120).alias("message"))


# ---------------------------------------------------------------- filters and pages


@query(
    "flt_1_list_articles",
    "SELECT article_id, title, domain, published_s, substr(coalesce(content, ''), 1, 240) AS excerpt FROM articles WHERE status = 'processed' AND (title ILIKE '%the%' OR author ILIKE '%the%') ORDER BY published_s DESC NULLS LAST, article_id LIMIT 40 OFFSET 10",
)
def flt_1(spark, sf_dir):
    return listing.list_articles(domain.articles(spark, sf_dir), "the", None, 40, 10)


@query("flt_2_recent_articles", "SELECT article_id, domain, coalesce(collected_s, published_s) AS at_s FROM articles ORDER BY at_s DESC NULLS LAST, article_id LIMIT 30")
def flt_2(spark, sf_dir):
    rows = domain.articles(spark, sf_dir).select("article_id", "domain", F.coalesce("collected_s", "published_s").alias("at_s"))
    return listing.newest(rows, F.col("at_s"), "article_id", 30)


@query(
    "flt_3_list_verdicts",
    "SELECT t.total, p.* FROM (SELECT count(*) AS total FROM claims WHERE verdict = 'SUPPORTED') t LEFT JOIN (SELECT claim_id, probability, verdict, domain FROM claims WHERE verdict = 'SUPPORTED' ORDER BY probability NULLS LAST, claim_id LIMIT 50) p ON TRUE",
)
def flt_3(spark, sf_dir):
    return listing.list_verdicts(domain.claims(spark, sf_dir), "SUPPORTED")


@query("flt_4_eligible_at_cutoff", f"SELECT c.claim_id, c.published_s FROM claims c JOIN articles a USING (article_id) WHERE c.extracted_s <= {_NOW} - 864000 AND a.collected_s <= {_NOW} - 864000 AND c.published_s <= {_NOW} - 864000")
def flt_4(spark, sf_dir):
    rows = domain.claims(spark, sf_dir).join(domain.articles(spark, sf_dir).select("article_id", "collected_s"), "article_id")
    return listing.eligible_at(rows, _now(spark, sf_dir) - 864_000, True).select("claim_id", "published_s")


@query("flt_5_valid_vectors", "SELECT vec_id, label FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0")
def flt_5(spark, sf_dir):
    return listing.valid_vectors(domain.table(spark, sf_dir, "embeddings")).select("vec_id", "label")


@query("flt_6_seeded_sample", "SELECT claim_id, claim_text FROM claims WHERE length(claim_text) BETWEEN 40 AND 240 ORDER BY md5(claim_id::VARCHAR || ':s1'), claim_id LIMIT 50")
def flt_6(spark, sf_dir):
    rows = domain.claims(spark, sf_dir).where(F.length("claim_text").between(40, 240))
    return listing.seeded_sample(rows, "claim_id", "s1", 50).select("claim_id", "claim_text")


@query("flt_7_unscored_claims", "SELECT claim_id, confidence FROM claims WHERE verdict IS NULL ORDER BY confidence DESC NULLS LAST, claim_id LIMIT 100")
def flt_7(spark, sf_dir):
    return listing.unscored(domain.claims(spark, sf_dir), 100).select("claim_id", "confidence")


@query("flt_8_newest_with_flag", "SELECT article_id, published_s, (SELECT count(*) FROM articles) > 150 AS truncated FROM articles ORDER BY published_s DESC NULLS LAST, article_id LIMIT 150")
def flt_8(spark, sf_dir):
    return listing.newest_with_flag(domain.articles(spark, sf_dir), 150).select("article_id", "published_s", "truncated")


# ---------------------------------------------------------------- joins


@query("jn_1_claims_with_articles", "SELECT c.claim_id, a.title, a.language FROM claims c JOIN articles a USING (article_id)")
def jn_1(spark, sf_dir):
    return domain.claims(spark, sf_dir).join(domain.articles(spark, sf_dir).select("article_id", "title", "language"), "article_id").select("claim_id", "title", "language")


@query(
    "jn_2_pair_metadata",
    """SELECT r.from_id, r.to_id, ca.article_id AS article_a, cb.article_id AS article_b, aa.domain AS domain_a, ab.domain AS domain_b FROM relations r
    LEFT JOIN claims ca ON ca.claim_id = r.from_id LEFT JOIN claims cb ON cb.claim_id = r.to_id LEFT JOIN articles aa ON aa.article_id = ca.article_id LEFT JOIN articles ab ON ab.article_id = cb.article_id""",
)
def jn_2(spark, sf_dir):
    claim, article = domain.claims(spark, sf_dir).select("claim_id", "article_id"), domain.articles(spark, sf_dir).select("article_id", "domain")
    rows = domain.relations(spark, sf_dir).select("from_id", "to_id").join(claim.toDF("from_id", "article_a"), "from_id", "left").join(claim.toDF("to_id", "article_b"), "to_id", "left")
    return rows.join(article.toDF("article_a", "domain_a"), "article_a", "left").join(article.toDF("article_b", "domain_b"), "article_b", "left")


@query("jn_3_edges_among_chosen", "SELECT from_id, to_id, kind FROM relations WHERE from_id IN (SELECT claim_id FROM claims WHERE confidence >= 0.5) AND to_id IN (SELECT claim_id FROM claims WHERE confidence >= 0.5)")
def jn_3(spark, sf_dir):
    chosen = domain.claims(spark, sf_dir).where("confidence >= 0.5").select("claim_id")
    rows = domain.relations(spark, sf_dir).join(chosen.toDF("from_id"), "from_id", "left_semi").join(chosen.toDF("to_id"), "to_id", "left_semi")
    return rows.select("from_id", "to_id", "kind")


@query("jn_4_not_yet_voted", "SELECT pair_id FROM eval_pairs p WHERE NOT EXISTS (SELECT 1 FROM votes v WHERE v.pair_id = p.pair_id AND v.annotator = 'user:1')")
def jn_4(spark, sf_dir):
    voted = domain.votes(spark, sf_dir).where("annotator = 'user:1'").select("pair_id")
    return domain.eval_pairs(spark, sf_dir).select("pair_id").join(voted, "pair_id", "left_anti")


@query("jn_9_duplicate_stars", "SELECT h.a, x.article_id AS b FROM articles x JOIN (SELECT content_hash, min(article_id) AS a FROM articles GROUP BY content_hash HAVING count(*) > 1) h USING (content_hash) WHERE x.article_id > h.a")
def jn_9(spark, sf_dir):
    return merging.duplicate_stars(domain.articles(spark, sf_dir))


_FEEDBACK = "feedback AS (SELECT event_id % 500 AS claim_id, user_id, CASE event_type WHEN 'click' THEN 'AGREE' ELSE 'DISAGREE' END AS vote, at_s FROM ev WHERE event_type IN ('click', 'error')), fb AS (SELECT coalesce(c.verdict, 'UNSCORED') AS band, f.vote FROM feedback f JOIN claims c USING (claim_id))"


def _feedback(spark, sf_dir):
    vote = F.when(F.col("event_type") == "click", "AGREE").otherwise("DISAGREE")
    rows = domain.events(spark, sf_dir).where("event_type in ('click', 'error')").select((F.col("event_id") % 500).alias("claim_id"), "user_id", vote.alias("vote"), "at_s")
    return rows.join(domain.claims(spark, sf_dir).select("claim_id", F.coalesce("verdict", F.lit("UNSCORED")).alias("band")), "claim_id")


@query("jn_11_feedback_bands", f", {_FEEDBACK} SELECT band, vote, count(*) AS n FROM fb GROUP BY ALL")
def jn_11(spark, sf_dir):
    return _feedback(spark, sf_dir).groupBy("band", "vote").agg(F.count("*").alias("n"))


@query(
    "jn_12_resolve_ids",
    """SELECT id, article_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority) AS rn FROM (
    SELECT article_id AS id, article_id, 0 AS priority FROM articles UNION ALL SELECT claim_id, article_id, 1 FROM claims)) WHERE rn = 1""",
)
def jn_12(spark, sf_dir):
    own = domain.articles(spark, sf_dir).select(F.col("article_id").alias("id"), "article_id", F.lit(0).alias("priority"))
    rows = own.unionByName(domain.claims(spark, sf_dir).select(F.col("claim_id").alias("id"), "article_id", F.lit(1).alias("priority")))
    return ranking.first_per_key(rows, ["id"], ["priority"]).drop("priority")


# ---------------------------------------------------------------- aggregations


@query("agg_1_domain_facet", "SELECT domain, count(*) AS n FROM articles GROUP BY domain")
def agg_1(spark, sf_dir):
    return agg.facet(domain.articles(spark, sf_dir), "domain")


@query("agg_2_corpus_stats", "SELECT count(*) AS articles, count(v.vec_id) AS embedded, count(DISTINCT domain) AS domains, min(published_s) AS first_s, max(published_s) AS last_s FROM articles a LEFT JOIN embeddings v ON v.vec_id = a.article_id")
def agg_2(spark, sf_dir):
    return agg.corpus_stats(domain.articles(spark, sf_dir), domain.table(spark, sf_dir, "embeddings"))


@query("agg_3_status_zero_filled", f"SELECT s.status, count(a.article_id) AS n FROM (SELECT unnest([{_in(lex.STATUSES)}]) AS status) s LEFT JOIN articles a USING (status) GROUP BY s.status")
def agg_3(spark, sf_dir):
    return agg.zero_filled(domain.articles(spark, sf_dir), "status", lex.STATUSES)


@query("agg_4_dashboard", "SELECT (SELECT count(*) FROM articles) AS articles, (SELECT count(*) FROM claims) AS claims, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS embedded, (SELECT count(*) FROM relations) AS relations")
def agg_4(spark, sf_dir):
    count = lambda df, n: df.agg(F.count("*").alias(n))
    vectors = domain.table(spark, sf_dir, "embeddings").where("embedding is not null")
    out = count(domain.articles(spark, sf_dir), "articles").crossJoin(count(domain.claims(spark, sf_dir), "claims"))
    return out.crossJoin(count(vectors, "embedded")).crossJoin(count(domain.relations(spark, sf_dir), "relations"))


@query("agg_5_verdict_distribution", "SELECT coalesce(verdict, 'UNSCORED') AS band, count(*) AS n, round(avg(probability), 6) AS avg_probability FROM claims GROUP BY ALL")
def agg_5(spark, sf_dir):
    return agg.verdict_distribution(domain.claims(spark, sf_dir))


_CREDIBILITY = """SELECT domain, count(*) AS claims, count(*) FILTER (WHERE verdict IN ('SUPPORTED', 'PARTIALLY_SUPPORTED')) AS supported, count(*) FILTER (WHERE verdict = 'DISPUTED') AS disputed,
round((count(*) FILTER (WHERE verdict IN ('SUPPORTED', 'PARTIALLY_SUPPORTED')) + 2) / (count(*) FILTER (WHERE verdict IN ('SUPPORTED', 'PARTIALLY_SUPPORTED', 'DISPUTED')) + 4)::DOUBLE, 6) AS credibility FROM claims WHERE verdict IS NOT NULL GROUP BY domain"""


@query("agg_6_outlet_credibility", _CREDIBILITY)
def agg_6(spark, sf_dir):
    return agg.outlet_credibility(domain.claims(spark, sf_dir))


@query("agg_7_outlet_leaderboard", f"SELECT domain, credibility, claims, row_number() OVER (ORDER BY credibility DESC, claims DESC, domain) AS place FROM ({_CREDIBILITY})")
def agg_7(spark, sf_dir):
    from pyspark.sql import Window as W

    order = W.orderBy(F.desc("credibility"), F.desc("claims"), "domain")
    return agg.outlet_credibility(domain.claims(spark, sf_dir)).select("domain", "credibility", "claims", F.row_number().over(order).alias("place"))


@query("agg_8_feedback_tally", f", {_FEEDBACK} SELECT band, count(*) FILTER (WHERE vote = 'AGREE') AS agree, count(*) FILTER (WHERE vote = 'DISAGREE') AS disagree, round(count(*) FILTER (WHERE vote = 'AGREE') / count(*)::DOUBLE, 4) AS rate FROM fb GROUP BY band")
def agg_8(spark, sf_dir):
    return agg.feedback_tally(_feedback(spark, sf_dir))


@query("agg_9_topic_claims", "SELECT topic_id, count(*) OVER (PARTITION BY topic_id) AS n, claim_id FROM claims WHERE topic_id >= 0")
def agg_9(spark, sf_dir):
    return agg.topic_claims(domain.claims(spark, sf_dir))


@query(
    "agg_10_outlet_neighbours",
    """SELECT x.domain, count(DISTINCT x.article_id) AS stories, count(DISTINCT CASE WHEN y.domain <> x.domain THEN y.article_id END) AS neighbours
    FROM articles x LEFT JOIN (SELECT a, b FROM article_edges UNION ALL SELECT b, a FROM article_edges) e ON e.a = x.article_id LEFT JOIN articles y ON y.article_id = e.b GROUP BY x.domain""",
)
def agg_10(spark, sf_dir):
    return agg.outlet_neighbours(domain.articles(spark, sf_dir), domain.article_edges(spark, sf_dir))


@query("agg_12_topic_bursts", f"SELECT topic_id, count(*) AS n FROM claims WHERE extracted_s >= {_NOW} - 1728000 AND topic_id >= 0 GROUP BY topic_id HAVING count(*) >= 8")
def agg_12(spark, sf_dir):
    return agg.bursts(domain.claims(spark, sf_dir), _now(spark, sf_dir) - 1_728_000, 8)


@query(
    "agg_13_cluster_dossier",
    """SELECT t.*, e.min_score, e.max_score, last_s - first_s AS span_s FROM (SELECT domain, count(*) AS size, min(published_s) AS first_s, max(published_s) AS last_s FROM articles GROUP BY domain) t
    LEFT JOIN (SELECT domain, min(score) AS min_score, max(score) AS max_score FROM article_edges e JOIN articles a ON a.article_id = e.a GROUP BY domain) e USING (domain)""",
)
def agg_13(spark, sf_dir):
    return agg.cluster_dossier(domain.articles(spark, sf_dir), domain.article_edges(spark, sf_dir))


@query("agg_14_vote_provenance", "SELECT o.origin, count(v.pair_id) AS votes, count(DISTINCT v.pair_id) AS pairs FROM (SELECT unnest(['HUMAN', 'WEAK', 'MODEL']) AS origin) o LEFT JOIN votes v USING (origin) GROUP BY o.origin")
def agg_14(spark, sf_dir):
    return agg.vote_provenance(domain.votes(spark, sf_dir), ["HUMAN", "WEAK", "MODEL"])


@query("agg_15_split_coverage", "SELECT split, count(*) AS pairs, count(v.pair_id) AS labelled FROM eval_pairs p LEFT JOIN (SELECT DISTINCT pair_id FROM votes) v USING (pair_id) GROUP BY split")
def agg_15(spark, sf_dir):
    return agg.coverage(domain.eval_pairs(spark, sf_dir), domain.votes(spark, sf_dir), "split")


@query("agg_17_fingerprint", "SELECT count(*) AS n, CAST(coalesce(sum(('0x' || substr(md5(claim_id || '|' || domain || '|' || coalesce(verdict, '~')), 1, 12))::UBIGINT), 0) AS VARCHAR) AS checksum FROM claims")
def agg_17(spark, sf_dir):
    return agg.fingerprint(domain.claims(spark, sf_dir), ["claim_id", "domain", "verdict"])


@query("agg_19_label_counts", "SELECT 'Article' AS label, count(*) AS n FROM articles UNION ALL SELECT 'Claim', count(*) FROM claims UNION ALL SELECT 'Source', count(DISTINCT domain) FROM articles UNION ALL SELECT 'EDGES', count(*) FROM relations")
def agg_19(spark, sf_dir):
    named = lambda df, n: df.select(F.lit(n).alias("label"))
    articles = domain.articles(spark, sf_dir)
    rows = named(articles, "Article").union(named(domain.claims(spark, sf_dir), "Claim")).union(named(articles.select("domain").distinct(), "Source")).union(named(domain.relations(spark, sf_dir), "EDGES"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- windows


@query(
    "win_1_edge_dedupe",
    """, edge AS (SELECT from_id, to_id, kind, score, created_s, 0 AS edge_id FROM relations UNION ALL SELECT from_id, to_id, kind, 1.0::DOUBLE - score, created_s + 60, 1 FROM relations)
    SELECT from_id, to_id, kind, score, created_s FROM (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, kind ORDER BY score DESC, created_s, edge_id) AS rn FROM edge) WHERE rn = 1""",
)
def win_1(spark, sf_dir):
    """Every relation comes twice, the second time later and with another score."""
    rows = domain.relations(spark, sf_dir).withColumn("edge_id", F.lit(0))
    again = rows.withColumns({"score": 1.0 - F.col("score"), "created_s": F.col("created_s") + 60, "edge_id": F.lit(1)})
    found = ranking.first_per_key(rows.unionByName(again), ["from_id", "to_id", "kind"], [F.desc("score"), "created_s", "edge_id"])
    return found.select("from_id", "to_id", "kind", "score", "created_s")


@query(
    "win_3_scoop_race",
    """, both_ways AS (SELECT a AS hub, b AS member FROM article_edges UNION ALL SELECT b, a FROM article_edges),
    hub AS (SELECT hub FROM both_ways GROUP BY hub HAVING count(DISTINCT member) >= 2),
    field0 AS (SELECT hub, member FROM both_ways WHERE hub IN (SELECT hub FROM hub) UNION SELECT hub, hub FROM hub),
    placed AS (SELECT hub, member, row_number() OVER (PARTITION BY hub ORDER BY published_s, member) AS place, published_s - min(published_s) OVER (PARTITION BY hub) AS lag_s,
      count(*) OVER (PARTITION BY hub) AS field, max(published_s) OVER (PARTITION BY hub) - min(published_s) OVER (PARTITION BY hub) AS spread_s
      FROM field0 JOIN articles ON article_id = member WHERE published_s IS NOT NULL)
    SELECT * FROM placed WHERE place <= 6 AND field >= 2""",
)
def win_3(spark, sf_dir):
    return ranking.scoop_race(domain.articles(spark, sf_dir), domain.article_edges(spark, sf_dir))


@query(
    "win_5_domain_round_robin",
    """SELECT article_id, domain, round FROM (SELECT *, min(article_id) OVER (PARTITION BY domain) AS f, row_number() OVER (PARTITION BY domain ORDER BY article_id) AS round FROM articles) ORDER BY round, f, article_id LIMIT 60""",
)
def win_5(spark, sf_dir):
    return ranking.round_robin(domain.articles(spark, sf_dir).select("article_id", "domain"), "domain", "article_id", 60)


@query("win_6_average_ranks", "SELECT pair_id, rank() OVER (ORDER BY sim_score) + (count(*) OVER (PARTITION BY sim_score) - 1) / 2.0::DOUBLE AS avg_rank FROM eval_pairs")
def win_6(spark, sf_dir):
    return ranking.average_ranks(domain.eval_pairs(spark, sf_dir), "sim_score").select("pair_id", "avg_rank")


@query("win_7_running_confusion", "SELECT sim_score, CAST(sum(sum(gold)) OVER w AS BIGINT) AS tp, CAST(sum(count(*) - sum(gold)) OVER w AS BIGINT) AS fp FROM eval_pairs GROUP BY sim_score WINDOW w AS (ORDER BY sim_score DESC)")
def win_7(spark, sf_dir):
    return ranking.running_confusion(domain.eval_pairs(spark, sf_dir)).drop("step")


@query(
    "win_8_latest_with_history",
    """SELECT pair_id, origin, max(CASE WHEN rn = 1 THEN label END) AS label, CAST(count(*) - 1 AS INTEGER) AS revisions, coalesce(string_agg(CASE WHEN rn > 1 THEN label END, ',' ORDER BY voted_s, annotator), '') AS history
    FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, origin ORDER BY voted_s DESC, annotator DESC) AS rn FROM votes) GROUP BY pair_id, origin""",
)
def win_8(spark, sf_dir):
    return ranking.latest_with_history(domain.votes(spark, sf_dir))


@query(
    "win_9_next_pair",
    """SELECT annotator, min(pair_id) AS pair_id FROM (SELECT DISTINCT annotator FROM votes) u, eval_pairs p
    WHERE NOT EXISTS (SELECT 1 FROM votes v WHERE v.annotator = u.annotator AND v.pair_id = p.pair_id) GROUP BY annotator""",
)
def win_9(spark, sf_dir):
    return ranking.next_pair(domain.eval_pairs(spark, sf_dir), domain.votes(spark, sf_dir))


# ---------------------------------------------------------------- set operations and upserts


@query("set_2_insert_if_absent", "SELECT url, min(article_id) AS article_id FROM articles WHERE article_id >= 100 AND url NOT IN (SELECT url FROM articles WHERE article_id < 100) GROUP BY url")
def set_2(spark, sf_dir):
    rows = domain.articles(spark, sf_dir).select("article_id", "url")
    return merging.insert_absent(rows.where("article_id < 100"), rows.where("article_id >= 100"), "url", ["article_id"])


@query(
    "set_3_edge_upsert",
    """SELECT coalesce(o.from_id, n.from_id) AS from_id, coalesce(o.to_id, n.to_id) AS to_id, coalesce(n.score, o.score) AS score FROM (SELECT * FROM relations WHERE from_id % 3 <> 0) o
    FULL JOIN (SELECT from_id, to_id, score / 2 AS score FROM relations WHERE from_id % 2 = 0) n ON o.from_id = n.from_id AND o.to_id = n.to_id""",
)
def set_3(spark, sf_dir):
    rows = domain.relations(spark, sf_dir).select("from_id", "to_id", "score")
    return merging.upsert(rows.where("from_id % 3 <> 0"), rows.where("from_id % 2 = 0").withColumn("score", F.col("score") / 2), ["from_id", "to_id"], ["score"])


@query(
    "set_4_prune_stale_parents",
    "SELECT from_id, to_id, kind FROM relations WHERE NOT (kind = 'EVOLVED_FROM' AND from_id % 2 = 1 AND from_id % 5 <> 0)",
)
def set_4(spark, sf_dir):
    rows = domain.relations(spark, sf_dir).select("from_id", "to_id", "kind")
    return merging.prune_stale_parents(rows, rows.where("from_id % 2 = 1"), rows.where("from_id % 5 = 0"))


@query(
    "set_6_undirected_union",
    """, dup AS (SELECT h.a, x.article_id AS b FROM articles x JOIN (SELECT content_hash, min(article_id) AS a FROM articles GROUP BY content_hash HAVING count(*) > 1) h USING (content_hash) WHERE x.article_id > h.a)
    SELECT a, b, round(score, 3) AS score, CASE WHEN r = 0 THEN 'SIMILAR' ELSE 'DUPLICATE_OF' END AS kind FROM (
    SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY r, score DESC) AS rn FROM (SELECT a, b, score, 0 AS r FROM article_edges UNION ALL SELECT a, b, 1.0, 1 FROM dup)) WHERE rn = 1""",
)
def set_6(spark, sf_dir):
    return merging.undirected_union(domain.article_edges(spark, sf_dir), merging.duplicate_stars(domain.articles(spark, sf_dir)))


# ---------------------------------------------------------------- graphs


_BOTH = "both_ways AS (SELECT a, b, score FROM article_edges UNION ALL SELECT b, a, score FROM article_edges)"


@query("gr_1_hubs", f", {_BOTH}, d AS (SELECT a AS node, count(*) AS degree, round(sum(score), 6) AS mass FROM both_ways GROUP BY a HAVING count(*) >= 3 ORDER BY degree DESC, mass DESC, node LIMIT 40) SELECT node, degree, mass, string_agg(b::VARCHAR, ',' ORDER BY score DESC, b) AS neighbours FROM both_ways JOIN d ON a = node GROUP BY ALL")
def gr_1(spark, sf_dir):
    return graph.hubs(domain.article_edges(spark, sf_dir), 3, 40)


_HOPS = f", {_BOTH}, h0 AS (SELECT doc_id AS root, doc_id AS node FROM documents), h1 AS (SELECT DISTINCT root, b AS node FROM h0 JOIN both_ways ON a = node), h2 AS (SELECT DISTINCT root, b AS node FROM h1 JOIN both_ways ON a = node), h3 AS (SELECT DISTINCT root, b AS node FROM h2 JOIN both_ways ON a = node), hops AS (SELECT root, node, min(hop) AS hop FROM (SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3) GROUP BY ALL)"


def _roots(spark, sf_dir):
    return domain.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("root"))


@query(
    "gr_3_focused_timelines",
    f"""{_HOPS}, deg AS (SELECT a AS node, count(*) AS degree FROM both_ways GROUP BY a),
    m AS (SELECT h.root, h.node, row_number() OVER (PARTITION BY h.root ORDER BY a.published_s DESC NULLS LAST, h.node) AS place FROM hops h JOIN deg USING (node) JOIN articles a ON a.article_id = h.node)
    SELECT root, node, place FROM m WHERE place <= 12""",
)
def gr_3_timelines(spark, sf_dir):
    edges = domain.article_edges(spark, sf_dir)
    return graph.focused_timelines(edges, domain.articles(spark, sf_dir), _roots(spark, sf_dir), 3, 12)


@query(
    "gr_9_reach_with_fan_out",
    f"""{_HOPS}, level AS (SELECT root, hop, count(*) AS reached FROM hops GROUP BY ALL), fan AS (SELECT root, hop, reached, lead(reached, 1, 0) OVER (PARTITION BY root ORDER BY hop) AS later FROM level)
    SELECT root, sum(CASE WHEN hop > 0 THEN reached ELSE 0 END)::BIGINT AS reached, round(sum(CASE WHEN hop > 0 THEN reached * pow(0.5, hop) ELSE 0.0 END), 6) AS expected, round(sum(later) / sum(CASE WHEN hop < 3 THEN reached ELSE 0 END)::DOUBLE, 6) AS fan_out,
      round(0.5 * sum(later) / sum(CASE WHEN hop < 3 THEN reached ELSE 0 END)::DOUBLE, 6) AS expected_fan_out FROM fan GROUP BY root""",
)
def gr_9_fan_out(spark, sf_dir):
    return graph.reach_with_fan_out(domain.article_edges(spark, sf_dir), _roots(spark, sf_dir), 0.5, 3)


@query(
    "gr_13_path_edges",
    f", {_BOTH}, paths AS (SELECT x.b AS a, x.a AS m, y.b AS c FROM both_ways x JOIN both_ways y ON x.a = y.a WHERE x.b < y.b) SELECT p.a, p.m, p.c, CAST(2 + count(e.a) AS INTEGER) AS n_edges FROM paths p LEFT JOIN article_edges e ON e.a = p.a AND e.b = p.c GROUP BY ALL",
)
def gr_13_edges(spark, sf_dir):
    """Each two-hop path with the number of edges inside its three nodes: three where it closes to a triangle."""
    edges = domain.article_edges(spark, sf_dir)
    closing = edges.select("a", F.col("b").alias("c"), F.lit(1).alias("closes"))
    paths = graph.two_hop_paths(edges).join(closing, ["a", "c"], "left")
    return paths.select("a", "m", "c", (F.lit(2) + F.coalesce("closes", F.lit(0))).cast("int").alias("n_edges"))


@query("gr_3_within_three_hops", f"{_HOPS} SELECT root, node, hop FROM hops")
def gr_3(spark, sf_dir):
    return graph.within_hops(domain.article_edges(spark, sf_dir), _roots(spark, sf_dir), 3)


@query("gr_9_reach_profile", f"{_HOPS} SELECT root, count(*) AS reached, round(sum(pow(0.5, hop)), 6) AS expected FROM hops WHERE hop > 0 GROUP BY root")
def gr_9(spark, sf_dir):
    return graph.reach_profile(domain.article_edges(spark, sf_dir), _roots(spark, sf_dir), 0.5, 3)


@query(
    "gr_8_longest_chain",
    """, e AS (SELECT from_id, to_id FROM relations WHERE kind = 'EVOLVED_FROM') SELECT CAST(coalesce(max(n), 0) AS INTEGER) AS longest_chain FROM (
    WITH RECURSIVE w AS (SELECT to_id AS at, 1 AS n FROM e UNION ALL SELECT e.to_id, n + 1 FROM w JOIN e ON e.from_id = w.at) SELECT max(n) AS n FROM w)""",
)
def gr_8(spark, sf_dir):
    return graph.longest_chain(domain.relations(spark, sf_dir).where("kind = 'EVOLVED_FROM'"))


@query(
    "gr_5_story_components",
    """, both_ways AS (SELECT a, b FROM article_edges UNION ALL SELECT b, a FROM article_edges), comp AS (WITH RECURSIVE w AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT w.node, e.b FROM w JOIN both_ways e ON e.a = w.seen) SELECT node, min(seen) AS component FROM w GROUP BY node)
    SELECT component, count(*) AS size, count(DISTINCT domain) AS outlets FROM comp JOIN articles ON article_id = node GROUP BY component HAVING count(*) >= 2 AND count(DISTINCT domain) >= 2""",
)
def gr_5(spark, sf_dir):
    nodes = domain.articles(spark, sf_dir).select(F.col("article_id").alias("node"), "domain")
    return graph.story_components(domain.article_edges(spark, sf_dir), nodes, 2, 2)


@query(
    "gr_6_token_components",
    """, token AS (SELECT article_id AS id, 'url:' || url AS t FROM articles WHERE url IS NOT NULL UNION ALL SELECT article_id, 'content_hash:' || content_hash FROM articles WHERE content_hash IS NOT NULL),
    link AS (SELECT DISTINCT x.id AS a, y.id AS b FROM token x JOIN token y USING (t)), comp AS (WITH RECURSIVE w AS (SELECT article_id AS node, article_id AS seen FROM articles UNION SELECT w.node, link.b FROM w JOIN link ON link.a = w.seen) SELECT node, min(seen) AS component FROM w GROUP BY node)
    SELECT node AS article_id, component FROM comp""",
)
def gr_6(spark, sf_dir):
    return graph.token_components(domain.articles(spark, sf_dir).select("article_id", "url", "content_hash"), "article_id", ["url", "content_hash"])


@query("gr_10_induced_by_outlet", "SELECT a, b, score FROM article_edges WHERE a IN (SELECT article_id FROM articles WHERE domain < 'src2') AND b IN (SELECT article_id FROM articles WHERE domain < 'src2')")
def gr_10(spark, sf_dir):
    nodes = domain.articles(spark, sf_dir).where("domain < 'src2'").select(F.col("article_id").alias("node"))
    return graph.induced(domain.article_edges(spark, sf_dir), nodes)


@query(
    "gr_12_graph_quality",
    """SELECT round(coalesce(avg(CASE WHEN r.kind = 'EVOLVED_FROM' AND c.published_s IS NOT NULL AND p.published_s IS NOT NULL THEN CAST(p.published_s <= c.published_s AS INTEGER) END), 1.0), 6) AS temporal_validity,
    round(coalesce(avg(CAST(r.score BETWEEN 0 AND 1 AS INTEGER)), 1.0), 6) AS score_consistency, round(count(*) / count(DISTINCT r.from_id)::DOUBLE, 6) AS mean_out_degree
    FROM relations r LEFT JOIN claims c ON c.claim_id = r.from_id LEFT JOIN claims p ON p.claim_id = r.to_id""",
)
def gr_12(spark, sf_dir):
    return graph.graph_quality(domain.relations(spark, sf_dir), domain.claims(spark, sf_dir))


@query("gr_13_two_hop_paths", f", {_BOTH} SELECT x.b AS a, x.a AS m, y.b AS c FROM both_ways x JOIN both_ways y ON x.a = y.a WHERE x.b < y.b")
def gr_13(spark, sf_dir):
    return graph.two_hop_paths(domain.article_edges(spark, sf_dir))


# ---------------------------------------------------------------- evaluation


_COUNTS = "count(*) FILTER (WHERE sim_score >= {t} AND gold = 1) AS tp, count(*) FILTER (WHERE sim_score >= {t} AND gold = 0) AS fp, count(*) FILTER (WHERE NOT sim_score >= {t} AND gold = 1) AS fn"
_PRF = "round(CASE WHEN tp + fp <> 0 THEN tp / (tp + fp)::DOUBLE END, 6) AS precision, round(CASE WHEN tp + fn <> 0 THEN tp / (tp + fn)::DOUBLE END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1"


@query("ev_1_binary_metrics", f"SELECT split, tp, fp, fn, {_PRF} FROM (SELECT split, {_COUNTS.format(t=0.6)} FROM eval_pairs GROUP BY split)")
def ev_1(spark, sf_dir):
    return evaluation.binary_metrics(domain.eval_pairs(spark, sf_dir), 0.6, ["split"])


@query(
    "ev_2_auroc",
    """SELECT round((sum(r) FILTER (WHERE gold = 1) - count(*) FILTER (WHERE gold = 1) * (count(*) FILTER (WHERE gold = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE gold = 1) * count(*) FILTER (WHERE gold = 0))::DOUBLE, 6) AS auroc
    FROM (SELECT gold, rank() OVER (ORDER BY sim_score) + (count(*) OVER (PARTITION BY sim_score) - 1) / 2.0::DOUBLE AS r FROM eval_pairs)""",
)
def ev_2(spark, sf_dir):
    return evaluation.auroc(domain.eval_pairs(spark, sf_dir))


_CURVE = ", curve AS (SELECT sim_score, sum(sum(gold)) OVER w AS tp, sum(count(*) - sum(gold)) OVER w AS fp, (SELECT sum(gold) FROM eval_pairs) AS p FROM eval_pairs GROUP BY sim_score WINDOW w AS (ORDER BY sim_score DESC))"


@query("ev_3_average_precision", f"{_CURVE} SELECT round(sum(tp / (tp + fp)::DOUBLE * step / p::DOUBLE), 6) AS average_precision FROM (SELECT *, tp - coalesce(lag(tp) OVER (ORDER BY sim_score DESC), 0) AS step FROM curve)")
def ev_3(spark, sf_dir):
    return evaluation.average_precision(domain.eval_pairs(spark, sf_dir))


@query("ev_4_best_threshold", f"{_CURVE} SELECT round(f, 6) AS f1, round(sim_score, 6) AS threshold FROM (SELECT sim_score, round(2 * tp / (tp + fp + p)::DOUBLE, 9) AS f FROM curve) ORDER BY f DESC, sim_score DESC LIMIT 1")
def ev_4(spark, sf_dir):
    return evaluation.best_threshold(domain.eval_pairs(spark, sf_dir))


@query("ev_5_threshold_sweep", f"SELECT threshold, {_PRF} FROM (SELECT t::DOUBLE AS threshold, {_COUNTS.format(t='t::DOUBLE')} FROM eval_pairs, (SELECT unnest([0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS t) GROUP BY t)")
def ev_5(spark, sf_dir):
    return evaluation.sweep(domain.eval_pairs(spark, sf_dir), [0.4, 0.5, 0.6, 0.7, 0.8, 0.9])


@query(
    "ev_6_cohen_kappa",
    """, cells AS (SELECT x.annotator, y.annotator AS other, x.label, y.label AS other_label, count(*) AS n FROM votes x JOIN votes y USING (pair_id) WHERE x.annotator < y.annotator GROUP BY ALL),
    t AS (SELECT annotator, other, sum(n) AS items, sum(CASE WHEN label = other_label THEN n ELSE 0 END) AS same FROM cells GROUP BY ALL),
    c AS (SELECT r.annotator, r.other, sum(x * y) AS xy FROM (SELECT annotator, other, label, sum(n) AS x FROM cells GROUP BY ALL) r JOIN (SELECT annotator, other, other_label AS label, sum(n) AS y FROM cells GROUP BY ALL) q USING (annotator, other, label) GROUP BY ALL)
    SELECT annotator, other, CAST(items AS BIGINT) AS items, round(CASE WHEN pe = 1 THEN 1.0 ELSE (same / items::DOUBLE - pe) / (1 - pe) END, 6) AS kappa FROM (SELECT t.*, coalesce(xy, 0) / (items * items)::DOUBLE AS pe FROM t LEFT JOIN c USING (annotator, other))""",
)
def ev_6(spark, sf_dir):
    return evaluation.cohen_kappa(domain.votes(spark, sf_dir))


_BINS = "SELECT CAST(CASE " + " ".join(f"WHEN sim_score > {k / 10} THEN {k}" for k in range(9, 0, -1)) + " ELSE 0 END AS INTEGER) AS bin, count(*) AS n, round(avg(sim_score), 6) AS mean_score, round(avg(gold), 6) AS positive_rate FROM eval_pairs GROUP BY bin"


@query("ev_7_reliability_bins", _BINS)
def ev_7(spark, sf_dir):
    return evaluation.reliability(domain.eval_pairs(spark, sf_dir))


@query("ev_7_brier", "SELECT round(avg(pow(sim_score - gold, 2)), 6) AS brier FROM eval_pairs")
def ev_7b(spark, sf_dir):
    return evaluation.brier(domain.eval_pairs(spark, sf_dir))


@query("ev_7_calibration_error", f"SELECT round(sum(n * abs(mean_score - positive_rate)) / sum(n)::DOUBLE, 5) AS ece FROM ({_BINS})")
def ev_7c(spark, sf_dir):
    return evaluation.calibration_error(domain.eval_pairs(spark, sf_dir))


def _erfc_sql(x: str) -> str:
    t = f"(1 / (1 + 0.5 * {x}))"
    fit = f"{evaluation.ERFC[-1]}"
    for c in reversed(evaluation.ERFC[:-1]):
        fit = f"({c} + {t} * {fit})"
    return f"{t} * exp({fit} - {x} * {x})".replace("0.5 *", "0.5::DOUBLE *")


@query(
    "ev_10_mcnemar",
    f""", judged AS (SELECT (sim_score >= 0.5) = (gold = 1) AS first, (sim_score >= 0.7) = (gold = 1) AS second FROM eval_pairs),
    n AS (SELECT count(*) FILTER (first AND NOT second) AS b, count(*) FILTER (second AND NOT first) AS c FROM judged),
    raw AS (SELECT b, c, CASE WHEN b + c > 0 THEN pow(abs(b - c) - 1, 2) / (b + c)::DOUBLE ELSE 0 END AS s FROM n)
    SELECT b, c, round(s, 4) AS statistic, CASE WHEN s > 0 THEN round({_erfc_sql("sqrt(s / 2)")}, 6) ELSE 1.0::DOUBLE END AS p_value FROM raw""",
)
def ev_10(spark, sf_dir):
    return evaluation.mcnemar(domain.eval_pairs(spark, sf_dir), F.col("sim_score") >= 0.5, F.col("sim_score") >= 0.7)


@query("ev_11_human_consensus", "SELECT pair_id, count(DISTINCT annotator) AS voters, min(label) AS label FROM votes WHERE origin = 'HUMAN' GROUP BY pair_id HAVING count(DISTINCT annotator) >= 2 AND min(label) = max(label)")
def ev_11(spark, sf_dir):
    return evaluation.human_consensus(domain.votes(spark, sf_dir))


@query("ev_12_weak_majority", "SELECT pair_id, origin, label FROM (SELECT *, rank() OVER (PARTITION BY pair_id, origin ORDER BY n DESC) AS r, count(*) OVER (PARTITION BY pair_id, origin, n) AS k FROM (SELECT pair_id, origin, label, count(*) AS n FROM votes GROUP BY ALL)) WHERE r = 1 AND k = 1")
def ev_12(spark, sf_dir):
    return evaluation.weak_majority(domain.votes(spark, sf_dir))


@query(
    "ev_20_confusion",
    """, p AS (SELECT x.label AS gold, y.label AS predicted FROM votes x JOIN votes y USING (pair_id) WHERE x.annotator = 'user:1' AND y.annotator = 'user:2'),
    l AS (SELECT gold AS label, CAST(gold = predicted AS INTEGER) AS tp, 0 AS fp, CAST(gold <> predicted AS INTEGER) AS fn FROM p UNION ALL SELECT predicted, 0, CAST(gold <> predicted AS INTEGER), 0 FROM p)
    SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, coalesce(round(CASE WHEN tp + fp <> 0 THEN tp / (tp + fp)::DOUBLE END, 6), 0.0) AS precision, coalesce(round(CASE WHEN tp + fn <> 0 THEN tp / (tp + fn)::DOUBLE END, 6), 0.0) AS recall, coalesce(round(CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6), 0.0) AS f1
    FROM (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM l GROUP BY label)""",
)
def ev_20(spark, sf_dir):
    votes = domain.votes(spark, sf_dir)
    pairs = votes.where("annotator = 'user:1'").select("pair_id", F.col("label").alias("gold")).join(votes.where("annotator = 'user:2'").select("pair_id", F.col("label").alias("predicted")), "pair_id")
    return evaluation.confusion(pairs, "gold", "predicted")


# ---------------------------------------------------------------- alerts


_DAYS = "count(*) FILTER (WHERE {n} - {c} BETWEEN 0 AND 86400) AS recent, count(*) FILTER (WHERE {n} - {c} > 86400 AND {n} - {c} <= 172800) AS prior"
_AL1 = (
    f", c AS (SELECT 'INGESTION_SPIKE' AS kind, {_DAYS.format(n=_NOW, c='published_s')} FROM articles "
    f"UNION ALL SELECT 'DISPUTED_SURGE', {_DAYS.format(n=_NOW, c='extracted_s')} FROM claims WHERE verdict = 'DISPUTED' "
    f"UNION ALL SELECT 'MUTATION_SURGE', {_DAYS.format(n=_NOW, c='created_s')} FROM relations WHERE kind = 'EVOLVED_FROM')"
)


def _alert_counts(spark, sf_dir):
    now = _now(spark, sf_dir)
    parts = [
        alerts.recent_and_prior(domain.articles(spark, sf_dir).select(F.col("published_s").alias("at_s")), "INGESTION_SPIKE", now),
        alerts.recent_and_prior(domain.claims(spark, sf_dir).where("verdict = 'DISPUTED'").select(F.col("extracted_s").alias("at_s")), "DISPUTED_SURGE", now),
        alerts.recent_and_prior(domain.relations(spark, sf_dir).where("kind = 'EVOLVED_FROM'").select(F.col("created_s").alias("at_s")), "MUTATION_SURGE", now),
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query("al_1_recent_and_prior", f"{_AL1} SELECT * FROM c")
def al_1(spark, sf_dir):
    return _alert_counts(spark, sf_dir)


@query(
    "al_2_alert_snapshot",
    f"""{_AL1}, rules AS (SELECT * FROM (VALUES ('INGESTION_SPIKE', 5, 'warn'), ('DISPUTED_SURGE', 3, 'warn'), ('MUTATION_SURGE', 3, 'critical')) r(kind, floor, severity)),
    raised AS (SELECT kind, severity, recent, prior FROM c JOIN rules USING (kind) WHERE recent >= floor AND recent >= 2 * greatest(prior, 1))
    SELECT * FROM raised UNION ALL SELECT 'QUIET', 'info', 0, 0 WHERE NOT EXISTS (SELECT 1 FROM raised)""",
)
def al_2(spark, sf_dir):
    return alerts.snapshot_alerts(_alert_counts(spark, sf_dir))


# ---------------------------------------------------------------- vectors


def _vectors(spark, sf_dir):
    return domain.table(spark, sf_dir, "embeddings").where("embedding is not null")


_COS = "list_cosine_similarity(list_transform({}, lambda x: x::DOUBLE), list_transform({}, lambda x: x::DOUBLE))"


@query(
    "jn_5_nearest_of_chosen",
    f"""SELECT q, id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS r FROM (
    SELECT x.vec_id AS q, y.vec_id AS id, {_COS.format("x.embedding", "y.embedding")} AS score FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 100 = 0)) WHERE r <= 4 AND score >= 0.2""",
)
def jn_5(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    found = vectors.nearest(rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 4)
    return found.where("score >= 0.2").select("q", "id", F.round("score", 5).alias("score"))


@query(
    "jn_5_nearest_other_outlet",
    f"""SELECT q, id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS r FROM (
    SELECT x.vec_id AS q, y.vec_id AS id, {_COS.format("x.embedding", "y.embedding")} AS score FROM embeddings x JOIN articles a ON a.article_id = x.vec_id JOIN embeddings y ON x.vec_id <> y.vec_id JOIN articles b ON b.article_id = y.vec_id
    WHERE x.vec_id % 100 = 0 AND a.domain <> b.domain)) WHERE r <= 5 AND score >= 0.2""",
)
def jn_5_other(spark, sf_dir):
    """Five nearest vectors of articles of other outlets; the threshold comes after the choice."""
    rows = _claim_vectors(spark, sf_dir)
    found = vectors.nearest(rows.where("id % 100 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"), "domain"), rows, 5, exclude_same="domain")
    return found.where("score >= 0.2").select("q", "id", F.round("score", 5).alias("score"))


def _claim_vectors(spark, sf_dir):
    """(id, v, domain, extracted_s, published_s): vectors with the article of the same id."""
    about = domain.articles(spark, sf_dir).select(F.col("article_id").alias("id"), "domain", F.col("collected_s").alias("extracted_s"), "published_s")
    return _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).join(about, "id")


@query(
    "gr_5_mutation_chains",
    f""", cv AS (SELECT vec_id AS id, embedding AS v, domain, collected_s, published_s FROM embeddings JOIN articles ON article_id = vec_id WHERE embedding IS NOT NULL),
    chosen AS (SELECT * FROM cv ORDER BY collected_s DESC NULLS LAST, id LIMIT 400),
    near AS (SELECT x.id AS a, y.id AS b, {_COS.format("x.v", "y.v")} AS score FROM chosen x JOIN cv y ON x.id <> y.id AND x.domain <> y.domain QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY score DESC, y.id) <= 5),
    link AS (SELECT a, b FROM near WHERE score >= 0.33 UNION SELECT b, a FROM near WHERE score >= 0.33),
    comp AS (WITH RECURSIVE w AS (SELECT a AS node, a AS seen FROM link UNION SELECT w.node, link.b FROM w JOIN link ON link.a = w.seen) SELECT node, min(seen) AS chain FROM w GROUP BY node),
    member AS (SELECT chain, node AS id, domain, published_s FROM comp JOIN cv ON cv.id = node), big AS (SELECT chain, count(*) AS size, count(DISTINCT domain) AS outlets FROM member GROUP BY chain HAVING count(*) >= 3 ORDER BY size DESC, chain LIMIT 8),
    placed AS (SELECT *, row_number() OVER (ORDER BY outlets DESC, size DESC, chain) AS place FROM big WHERE outlets >= 2)
    SELECT chain, CAST(place AS INTEGER) AS place, size, outlets, CAST(row_number() OVER (PARTITION BY chain ORDER BY published_s NULLS LAST, id) AS INTEGER) AS version, id FROM member JOIN placed USING (chain)""",
)
def gr_5_chains(spark, sf_dir):
    return graph.mutation_chains(_claim_vectors(spark, sf_dir), least=0.33)


@query(
    "jn_8_neighbour_edges",
    f"""SELECT least(q, id) AS a, greatest(q, id) AS b, round(max(score), 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS r FROM (
    SELECT x.vec_id AS q, y.vec_id AS id, {_COS.format("x.embedding", "y.embedding")} AS score FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 100 = 0)) WHERE r <= 5 GROUP BY 1, 2""",
)
def jn_8(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    found = vectors.nearest(rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 5)
    return vectors.undirected_best(found)


@query("fn_19_cosine_of_relations", f"SELECT r.a, r.b, round({_COS.format('x.embedding', 'y.embedding')}, 6) AS cosine FROM article_edges r JOIN embeddings x ON x.vec_id = r.a JOIN embeddings y ON y.vec_id = r.b")
def fn_19(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", "embedding")
    pairs = domain.article_edges(spark, sf_dir).join(rows.toDF("a", "x"), "a").join(rows.toDF("b", "y"), "b")
    return pairs.select("a", "b", F.round(vectors.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


_LAG = 7 * 86_400
_CAND = f""", tv AS (SELECT v.vec_id AS id, v.label AS topic, a.published_s AS t, v.embedding AS e, a.title FROM embeddings v JOIN articles a ON a.article_id = v.vec_id WHERE a.published_s IS NOT NULL AND v.label IS NOT NULL),
cand AS (SELECT * FROM (SELECT c.id AS child, p.id AS parent, {_COS.format("c.e", "p.e")} AS score, lower(array_to_string(regexp_extract_all(c.title, '{_TOKEN}'), ' ')) <> lower(array_to_string(regexp_extract_all(p.title, '{_TOKEN}'), ' ')) AS meaningful
  FROM tv c JOIN tv p ON c.topic = p.topic AND p.t < c.t AND p.t >= c.t - {_LAG} AND c.id <> p.id) WHERE score >= 0.1)"""


def _candidates(spark, sf_dir, most=None, least=0.1):
    rows = _vectors(spark, sf_dir).join(domain.articles(spark, sf_dir).select(F.col("article_id").alias("vec_id"), "published_s", "title"), "vec_id")
    rows = rows.select(F.col("vec_id").alias("id"), F.col("label").alias("topic"), "published_s", F.col("embedding").alias("v"), "title")
    rows = stage(rows, "vector-articles")  # read on both sides, counted and dealt
    return rows, vectors.earlier_candidates(rows, _LAG, least, most=most)


@query("jn_6_earlier_in_topic", f"{_CAND} SELECT child, parent, round(score, 6) AS score FROM cand")
def jn_6(spark, sf_dir):
    return _candidates(spark, sf_dir)[1].select("child", "parent", F.round("score", 6).alias("score"))


@query("jn_7_best_earlier_parent", f"{_CAND} SELECT child, parent, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY score DESC, parent) AS r FROM cand) WHERE r = 1")
def jn_7(spark, sf_dir):
    return ranking.first_per_key(_candidates(spark, sf_dir, 1)[1], ["child"], [F.desc("score"), "parent"]).select("child", "parent", F.round("score", 6).alias("score"))


@query(
    "pl_7_mutation_edges",
    f"""{_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY score DESC, parent) AS place FROM cand), f AS (SELECT *, min(CASE WHEN meaningful AND score >= 0.3 THEN place END) OVER (PARTITION BY child) AS first FROM r WHERE place <= 50)
    SELECT child, parent, kind, round(score, 4) AS score FROM (SELECT *, CASE WHEN place = first THEN 'EVOLVED_FROM' WHEN score >= 0.2 THEN 'SIMILAR_TO' END AS kind FROM f) WHERE kind IS NOT NULL""",
)
def pl_7(spark, sf_dir):
    rows, found = _candidates(spark, sf_dir, 50, 0.2)  # candidates below .2 stand behind all others and give no edge
    said = rows.select("id", F.unhex(F.sha2(F.array_join(tx.tokens(F.col("title")), " "), 256)).alias("said"))
    return vectors.mutation_edges(vectors.best_candidates(found, 50), said, 0.3, 0.2)


@query(
    "pl_15_semantic_search",
    f"""SELECT q, id, round(score, 4) AS score, r AS place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INTEGER) AS r FROM (
    SELECT x.vec_id AS q, y.vec_id AS id, {_COS.format("x.embedding", "y.embedding")} AS score FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 100 = 0)) WHERE r <= 10""",
)
def pl_15(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    found = vectors.nearest(rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 10)
    return found.select("q", "id", F.round("score", 4).alias("score"), "place")


# ---------------------------------------------------------------- claims and verdicts


_ENT = r""", ent AS (SELECT claim_id, unnest(list_concat(list_transform(regexp_extract_all(claim_text, '\$[0-9]+(?:[.,][0-9]+)*'), lambda x: {'t': x, 'k': 'MONEY'}), list_transform(regexp_extract_all(claim_text, '[0-9]+(?:\.[0-9]+)?%'), lambda x: {'t': x, 'k': 'PERCENT'}),
  list_transform(regexp_extract_all(claim_text, '\b(?:19|20)[0-9]{2}\b'), lambda x: {'t': x, 'k': 'DATE'}), list_transform(regexp_extract_all(claim_text, '[A-Z][a-z]{2,}(?: [A-Z][a-z]{2,})+'), lambda x: {'t': x, 'k': 'NAME'}))) AS e FROM claims),
esig AS (SELECT c.claim_id, count(e.e) AS total, count(*) FILTER (WHERE e.e.k IN ('MONEY', 'PERCENT', 'DATE')) AS strong FROM claims c LEFT JOIN ent e USING (claim_id) GROUP BY c.claim_id),
entity AS (SELECT *, CASE WHEN total = 0 THEN 0.3 WHEN strong = 0 THEN 0.45 ELSE least(100, 55 + 15 * strong) / 100.0::DOUBLE END::DOUBLE AS signal FROM esig)"""


def _spans_sql(pattern: str, kind: str = "") -> str:
    """Matches with their places: pieces between matches and matches take turns, so lengths add up to places."""
    return f"""SELECT claim_id, claim_text, unnest(range(1, len(m) + 1)) AS k, m, p, '{kind}' AS kind FROM (SELECT claim_id, claim_text, regexp_extract_all(claim_text, '{pattern}') AS m, string_split_regex(claim_text, '{pattern}') AS p FROM claims)"""


_PLACED = "SELECT *, m[k] AS t, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS INTEGER) AS s FROM found"


@query("fn_15_entity_rows", ", found AS (" + " UNION ALL ".join(_spans_sql(p, k) for k, p in spans.ENTITY_KINDS.items()) + f'), placed AS ({_PLACED}) SELECT claim_id, t AS entity_text, kind AS entity_type, s AS start, s + CAST(length(t) AS INTEGER) AS "end" FROM placed')
def fn_15(spark, sf_dir):
    return spans.entity_spans(domain.claims(spark, sf_dir))


#: The tokens' pattern in RE2: letters and digits by Unicode class, since \\w and \\d are ASCII there.
_TOKEN_RE2 = r"[+−-]?(?:[$€£]\s*)?\p{Nd}+(?:[.,]\p{Nd}+)*(?:\s?%|[kmbKMB]\b)?|[\p{L}\p{Nl}\p{No}]+(?:[''’][\p{L}\p{Nl}\p{No}]+)*|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


@query("fn_12_token_spans", f', found AS ({_spans_sql(_TOKEN_RE2)}), placed AS ({_PLACED}) SELECT claim_id, CAST(k AS INTEGER) AS position, t AS token, s AS start, s + CAST(length(t) AS INTEGER) AS "end" FROM placed')
def fn_12_spans(spark, sf_dir):
    """Every token of every claim with its place, by a table function that is joined laterally in SQL."""
    spans.register(spark)
    return spark.sql("SELECT claim_id, t.* FROM {claims} c, LATERAL text_tokens(c.claim_text) t", claims=domain.claims(spark, sf_dir).select("claim_id", "claim_text"))


@query("fn_1_clean_text")
def fn_1_whole(spark, sf_dir):
    """Every page's text with all entities and in NFKC."""
    return domain.table(spark, sf_dir, "pages").select("page_id", spans.clean_text("html").alias("cleaned"))


@query("fn_2_whole_display")
def fn_2_whole(spark, sf_dir):
    """Every page's text for display, with all entities."""
    return domain.table(spark, sf_dir, "pages").select("page_id", spans.display_text(200)("html").alias("shown"))


@query("fn_21_text_key")
def fn_21_whole(spark, sf_dir):
    """Identity of every document's text in NFKC, case-folded; null below 80 characters."""
    return domain.table(spark, sf_dir, "documents").select("doc_id", spans.identity_key(80)("text").alias("key"))


@query("fn_24_entity_signal", _ENT + " SELECT claim_id, total, strong, signal FROM entity")
def fn_24(spark, sf_dir):
    rows = domain.claims(spark, sf_dir)
    return verdicts.entity_signal(rows, verdicts.entity_rows(rows))


_EVID = """, evid AS (SELECT r.from_id AS claim_id, c.domain, 'g' || (r.to_id // 16) AS syndication_group, CASE r.to_id % 5 WHEN 0 THEN 'contradiction' WHEN 1 THEN 'neutral' ELSE 'entailment' END AS stance FROM (SELECT from_id, to_id FROM relations UNION ALL SELECT claim_id, claim_id + 40 FROM claims) r JOIN claims c ON c.claim_id = r.to_id),
once AS (SELECT e.claim_id, e.syndication_group, e.stance, min(e.domain) AS domain FROM evid e JOIN claims c USING (claim_id) WHERE e.domain <> c.domain GROUP BY ALL),
cnt AS (SELECT claim_id, count(DISTINCT CASE WHEN stance = 'entailment' THEN domain END) AS support, count(DISTINCT CASE WHEN stance = 'contradiction' THEN domain END) AS against FROM once GROUP BY claim_id),
corr AS (SELECT claim_id, support, against, round(CASE WHEN support = 0 THEN 0.3 ELSE 0.35 + 0.65 * (1 - exp(-support / 1.5::DOUBLE)) END, 3)::DOUBLE AS corroboration, round(0.5 - 0.5 * CASE WHEN support + against > 0 THEN against / (support + against)::DOUBLE ELSE 0.0 END, 3)::DOUBLE AS contradiction
  FROM (SELECT claim_id, coalesce(support, 0) AS support, coalesce(against, 0) AS against FROM claims LEFT JOIN cnt USING (claim_id)))"""


def staged_claims(spark, sf_dir, *columns):
    """The named columns of all claims, staged: a query that reads them several times cuts the sentences once."""
    return stage(domain.claims(spark, sf_dir).select(*columns), "claims")


#: What evidence and outlets' records read of claims: no texts.
CLAIM_FACTS = ("claim_id", "article_id", "domain", "extracted_s", "topic_id", "verdict")


def _evidence(spark, sf_dir, of=None):
    """Evidence rows from relations and later claims; the stance is a stand-in by id, as no stance model is at hand."""
    claim = staged_claims(spark, sf_dir, *CLAIM_FACTS) if of is None else of
    pairs = domain.relations(spark, sf_dir, claim).select(F.col("from_id").alias("c"), F.col("to_id").alias("claim_id")).union(claim.select(F.col("claim_id").alias("c"), F.col("claim_id") + 40))
    stance = F.expr("case claim_id % 5 when 0 then 'contradiction' when 1 then 'neutral' else 'entailment' end")
    rows = pairs.join(claim.select("claim_id", "domain"), "claim_id")
    return rows.select(F.col("c").alias("claim_id"), "domain", F.concat(F.lit("g"), F.floor(F.col("claim_id") / 16).cast("string")).alias("syndication_group"), stance.alias("stance"))


@query("pl_9_assessment", _EVID + " SELECT claim_id, CASE WHEN s AND c THEN 'mixed' WHEN c THEN 'contradict' WHEN s THEN 'support' ELSE 'insufficient' END AS assessment FROM (SELECT claim_id, bool_or(stance = 'entailment') AS s, bool_or(stance = 'contradiction') AS c FROM evid GROUP BY claim_id)")
def pl_9(spark, sf_dir):
    return verdicts.assessment(_evidence(spark, sf_dir))


@query("pl_11_corroboration", _EVID + " SELECT claim_id, support, against, corroboration, contradiction FROM corr")
def pl_11(spark, sf_dir):
    claims = staged_claims(spark, sf_dir, *CLAIM_FACTS)
    return verdicts.corroboration(claims, _evidence(spark, sf_dir, claims))


_PRIORS = ", priors AS (SELECT domain, count(*) FILTER (WHERE verdict IN ('SUPPORTED', 'PARTIALLY_SUPPORTED')) AS supported, count(*) AS checked FROM claims WHERE verdict IS NOT NULL AND domain <> 'src3.example' GROUP BY domain), track AS (SELECT claim_id, round(coalesce((supported + 2) / (checked + 4)::DOUBLE, 0.5), 6)::DOUBLE AS signal FROM claims LEFT JOIN priors USING (domain))"


def _priors(spark, sf_dir, of=None):
    rows = (domain.claims(spark, sf_dir) if of is None else of).where("verdict is not null and domain <> 'src3.example'")
    return rows.groupBy("domain").agg(F.count_if(F.col("verdict").isin("SUPPORTED", "PARTIALLY_SUPPORTED")).alias("supported"), F.count("*").alias("checked"))


@query("pl_12_track_record", _PRIORS + " SELECT claim_id, signal FROM track")
def pl_12(spark, sf_dir):
    return verdicts.track_record(domain.claims(spark, sf_dir), _priors(spark, sf_dir))


def _language_sql() -> str:
    return ORACLE_SQL["fn_23_language_signal"].split(domain.VIEWS_SQL.strip())[1].strip()


@query(
    "pl_14_verdict_batch",
    f"""{_ENT}{_EVID}{_PRIORS}, lang AS ({_language_sql()}),
    sig AS (SELECT claim_id, 0.4 AS w, corroboration AS v FROM corr UNION ALL SELECT claim_id, 0.2, contradiction FROM corr UNION ALL SELECT claim_id, 0.15, signal FROM track UNION ALL SELECT claim_id, 0.15, signal FROM entity UNION ALL SELECT claim_id, 0.1, signal FROM lang),
    pooled AS (SELECT claim_id, round(least(0.98, greatest(0.02, 1 / (1 + exp(-x)))), 4) AS probability FROM (SELECT claim_id, sum(w::DOUBLE * ln(h / (1 - h))) / sum(w::DOUBLE) AS x FROM (SELECT claim_id, w, least(0.99, greatest(0.01, v)) AS h FROM sig) GROUP BY claim_id))
    SELECT claim_id, probability, CASE WHEN against > 0 THEN CASE WHEN probability < 0.45 THEN 'DISPUTED' ELSE 'UNRESOLVED' END WHEN NOT support > 0 THEN CASE WHEN probability >= 0.38 THEN 'UNRESOLVED' ELSE 'UNSUPPORTED' END
      WHEN probability >= 0.72 THEN 'SUPPORTED' WHEN probability >= 0.55 THEN 'PARTIALLY_SUPPORTED' WHEN probability >= 0.38 THEN 'UNRESOLVED' ELSE 'WEAKLY_CORROBORATED' END AS band FROM pooled JOIN corr USING (claim_id)""",
)
def pl_14(spark, sf_dir):
    claims = staged_claims(spark, sf_dir, *CLAIM_FACTS, "claim_text")
    return verdicts.score_claims(claims, _evidence(spark, sf_dir, claims), _priors(spark, sf_dir, claims))


@query(
    "pl_8_evidence_passage",
    f"""SELECT article_id, claim_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY overlap DESC, claim_id) AS r FROM (
    SELECT c.article_id, c.claim_id, CAST(len(list_intersect(list_filter({_SET.format("a.title")}, lambda t: length(t) >= 3), {_SET.format("c.claim_text")})) AS BIGINT) AS overlap FROM claims c JOIN articles a USING (article_id))) WHERE r = 1""",
)
def pl_8(spark, sf_dir):
    return verdicts.evidence_passage(domain.claims(spark, sf_dir), domain.articles(spark, sf_dir))


@query("pl_8_body_passage")
def pl_8_body(spark, sf_dir):
    """Each claim in its own article; the body is searched whole."""
    pairs = domain.claims(spark, sf_dir).select("claim_id", "claim_text", "article_id", F.col("claim_text").alias("candidate"))
    return verdicts.body_passage(pairs, domain.articles(spark, sf_dir))




def change_sql(pairs: str, keys: str) -> str:
    """Views ending in `changed` (keys, types, overlap, meaningful) over a view of pairs (keys, a, b: older and newer text)."""
    differ = lambda tokens: f"list_sort({tokens.format('a')}) <> list_sort({tokens.format('b')})"
    within = lambda words: f"list_filter(t{{0}}, lambda x: x IN ({_in(words)}))"
    phrases = ", ".join(f"CASE WHEN contains(j{{0}}, ' {p} ') THEN '{p}' END" for p in lex.SCOPE_PHRASES)
    kinds = {
        "NUMERIC_DRIFT": r"list_filter(t{0}, lambda x: regexp_matches(x, '^[+\-]?\$?[0-9]'))",
        "ENTITY_SUBSTITUTION": f"list_filter(s{{0}}, lambda x: regexp_matches(x, '^([A-Z][a-zA-Z]{{{{2,}}}}|[A-Z]{{{{2}}}})$') AND lower(x) NOT IN ({_in(_COMMON)}))",
        "POLARITY_SHIFT": within(lex.POLARITY_WORDS),
        "HEDGING_SHIFT": within(lex.HEDGE_WORDS),
        "ATTRIBUTION_SHIFT": within(lex.ATTRIBUTION_WORDS),
        "SCOPE_SHIFT": f"list_concat({within(lex.SCOPE_WORDS)}, list_filter([{phrases}], lambda x: x IS NOT NULL))",
    }
    typed = ", ".join(f"CASE WHEN {differ(t)} THEN '{k}' END" for k, t in kinds.items())
    split = ", ".join(f"regexp_extract_all(lower({c}), '{_TOKEN}') AS t{c}, regexp_extract_all({c}, '{_TOKEN}') AS s{c}, {_SET.format(c)} AS w{c}" for c in "ab")
    return f"""split_pairs AS (SELECT {keys}, {split} FROM {pairs}),
    joined_pairs AS (SELECT *, ' ' || array_to_string(ta, ' ') || ' ' AS ja, ' ' || array_to_string(tb, ' ') || ' ' AS jb,
      CASE WHEN len(list_distinct(list_concat(wa, wb))) > 0 THEN len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb)))::DOUBLE ELSE 1.0 END AS overlap FROM split_pairs),
    typed_pairs AS (SELECT {keys}, overlap, ja = jb AS same, list_filter([{typed}], lambda x: x IS NOT NULL) AS k FROM joined_pairs),
    changed AS (SELECT {keys}, CASE WHEN same THEN 'NEAR_DUPLICATE' ELSE array_to_string(CASE WHEN overlap < 0.65 THEN list_append(k, 'FRAMING_SHIFT') WHEN overlap < 0.9 OR len(k) = 0 THEN list_append(k, 'WORDING_DRIFT') ELSE k END, ',') END AS types,
      overlap, NOT same AS meaningful FROM typed_pairs)"""


RELATION_PAIRS = "relation_pairs AS (SELECT r.from_id, r.to_id, r.kind, r.created_s, p.claim_text AS a, c.claim_text AS b FROM relations r JOIN claims p ON p.claim_id = r.to_id JOIN claims c ON c.claim_id = r.from_id)"


def relation_changes(spark, sf_dir, of=None):
    """Relations (from_id the newer claim, to_id the older one, kind, created_s) with types, overlap and meaningful."""
    claims = staged_claims(spark, sf_dir, "claim_id", "claim_text", "extracted_s") if of is None else of
    text = claims.select("claim_id", "claim_text")
    pairs = domain.relations(spark, sf_dir, claims).select("from_id", "to_id", "kind", "created_s").join(text.toDF("from_id", "b"), "from_id").join(text.toDF("to_id", "a"), "to_id")
    return verdicts.text_change(pairs).drop("a", "b")


@query("pl_5_text_change", f", {RELATION_PAIRS}, {change_sql('relation_pairs', 'from_id, to_id')} SELECT from_id, to_id, types, round(overlap, 6) AS overlap, meaningful FROM changed")
def pl_5(spark, sf_dir):
    return relation_changes(spark, sf_dir).select("from_id", "to_id", "types", F.round("overlap", 6).alias("overlap"), "meaningful")


@query("pl_17_topic_timeline", "SELECT topic_id, CAST(count(*) AS INTEGER) AS n, string_agg(claim_id::VARCHAR, ',' ORDER BY published_s, claim_id) AS claim_ids FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY published_s, claim_id) AS r FROM claims WHERE topic_id >= 0 AND published_s IS NOT NULL) WHERE r <= 50 GROUP BY topic_id HAVING count(*) >= 2")
def pl_17(spark, sf_dir):
    rows = domain.claims(spark, sf_dir).where("topic_id >= 0 and published_s is not null")
    from pyspark.sql import Window as W

    first = rows.withColumn("r", F.row_number().over(W.partitionBy("topic_id").orderBy("published_s", "claim_id"))).where("r <= 50")
    lists = first.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("published_s", "claim_id"))).alias("x")).where(F.size("x") >= 2)
    return lists.select("topic_id", F.size("x").alias("n"), F.array_join(F.transform("x", lambda e: e["claim_id"].cast("string")), ",").alias("claim_ids"))


# ---------------------------------------------------------------- more joins, windows, sets and alerts


_SPACE = r"[^\x20\x09-\x0D]+"
#: Pairs of articles with a Jaccard similarity of three-word shingles from .75, collected within 14 days of each other.
NEAR_PAIRS = f"""
, near_word AS (SELECT article_id AS id, collected_s AS at_s, regexp_extract_all(content, '{_SPACE}') AS w FROM articles WHERE content IS NOT NULL AND collected_s IS NOT NULL),
near_set AS (SELECT id, at_s, list_distinct(list_transform(range(1, len(w) - 1), lambda i: hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM near_word WHERE len(w) >= 3),
near_item AS (SELECT id, at_s, len(s) AS n, unnest(s) AS x FROM near_set),
near_both AS (SELECT p.id AS a, q.id AS b, any_value(p.n) AS n, any_value(q.n) AS m, count(*) AS both_have FROM near_item p JOIN near_item q ON p.x = q.x AND (p.at_s, p.id) < (q.at_s, q.id)
  AND q.at_s - p.at_s <= 1209600 AND least(p.n, q.n) >= 0.75 * greatest(p.n, q.n) GROUP BY p.id, q.id),
near_pair AS (SELECT a, b, both_have / (n + m - both_have)::DOUBLE AS jaccard FROM near_both WHERE both_have * 4 >= 3 * (n + m - both_have))"""


@query(
    "jn_10_near_duplicates",
    f"""{NEAR_PAIRS},
    copies AS (SELECT x.article_id AS a, y.article_id AS b FROM (SELECT arg_min(article_id, (collected_s, article_id)) AS article_id, content FROM articles WHERE content IS NOT NULL AND collected_s IS NOT NULL GROUP BY content) x JOIN articles y USING (content)),
    link AS (SELECT a, b FROM near_pair UNION SELECT b, a FROM near_pair UNION SELECT a, b FROM copies UNION SELECT b, a FROM copies),
    chain AS (WITH RECURSIVE w AS (SELECT DISTINCT a AS node, a AS seen FROM link UNION SELECT w.node, link.b FROM w JOIN link ON link.a = w.seen) SELECT node, seen FROM w),
    root AS (SELECT node, arg_min(seen, (collected_s, seen)) AS canonical_id FROM chain JOIN articles ON article_id = seen WHERE collected_s IS NOT NULL GROUP BY node)
    SELECT article_id AS id, coalesce(canonical_id, article_id) AS canonical_id FROM articles LEFT JOIN root ON node = article_id""",
)
def jn_10(spark, sf_dir):
    return _canonical(spark, sf_dir)


def _canonical(spark, sf_dir):
    """(id, canonical_id) of all articles."""
    times = domain.articles(spark, sf_dir).select(F.col("article_id").alias("id"), F.col("collected_s").alias("at_s"))
    return neardup.near_duplicates(domain.untimed_articles(spark, sf_dir).select(F.col("article_id").alias("id"), F.col("content").alias("text")), times=times)


@query("win_2_canonical_pair_key", "SELECT from_id, to_id, CASE WHEN row_number() OVER (PARTITION BY least(from_id, to_id), greatest(from_id, to_id) ORDER BY from_id, to_id) = 1 THEN least(from_id::VARCHAR, to_id::VARCHAR) || ':' || greatest(from_id::VARCHAR, to_id::VARCHAR) END AS key FROM (SELECT from_id, to_id FROM relations UNION ALL SELECT to_id, from_id FROM relations)")
def win_2(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = domain.relations(spark, sf_dir).select("from_id", "to_id")
    rows = rows.union(rows.select("to_id", "from_id"))
    first = F.row_number().over(W.partitionBy(F.least("from_id", "to_id"), F.greatest("from_id", "to_id")).orderBy("from_id", "to_id")) == 1
    return rows.select("from_id", "to_id", F.when(first, tx.pair_key(F.col("from_id"), F.col("to_id"))).alias("key"))


@query("win_11_latest_run", "SELECT user_id, max_by(event_id, (at_s, event_id)) AS event_id, max(at_s) AS at_s FROM ev GROUP BY user_id")
def win_11(spark, sf_dir):
    return domain.events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_id", F.struct("at_s", "event_id")).alias("event_id"), F.max("at_s").alias("at_s"))


@query("set_1_root_and_neighbours", f", {_BOTH} SELECT DISTINCT node FROM (SELECT doc_id AS node FROM documents UNION ALL SELECT b FROM both_ways)")
def set_1(spark, sf_dir):
    roots = domain.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"))
    near = graph.both_ways(domain.article_edges(spark, sf_dir)).select(F.col("b").alias("node"))
    return roots.union(near).distinct()


_ALERTS = ", old AS (SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS subject_key, min(at_s) AS first_seen_s, max(at_s) AS last_seen_s, min(CASE WHEN event_id % 4 = 0 THEN at_s END) AS acknowledged_s FROM ev WHERE event_id % 2 = 0 GROUP BY ALL), new AS (SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS subject_key, min(at_s) AS first_seen_s, max(at_s) AS last_seen_s FROM ev WHERE event_id % 2 = 1 GROUP BY ALL)"


def _alert_tables(spark, sf_dir):
    rows = domain.events(spark, sf_dir).withColumns({"kind": F.col("event_type"), "subject_key": F.col("user_id").cast("string")})
    group = lambda df: df.groupBy("kind", "subject_key").agg(F.min("at_s").alias("first_seen_s"), F.max("at_s").alias("last_seen_s"), F.min(F.when(F.col("event_id") % 4 == 0, F.col("at_s"))).alias("acknowledged_s"))
    return group(rows.where("event_id % 2 = 0")), group(rows.where("event_id % 2 = 1")).drop("acknowledged_s").withColumn("acknowledged_s", F.lit(None).cast("long"))


@query("set_5_alert_upsert", f"{_ALERTS} SELECT coalesce(o.kind, n.kind) AS kind, coalesce(o.subject_key, n.subject_key) AS subject_key, coalesce(n.last_seen_s, o.last_seen_s) AS last_seen_s, coalesce(o.first_seen_s, n.first_seen_s) AS first_seen_s, o.acknowledged_s FROM old o FULL JOIN new n ON o.kind = n.kind AND o.subject_key = n.subject_key")
def set_5(spark, sf_dir):
    old, new = _alert_tables(spark, sf_dir)
    return merging.upsert(old, new, ["kind", "subject_key"], ["last_seen_s"], ["first_seen_s", "acknowledged_s"])


@query("al_4_alert_feed", f"{_ALERTS} SELECT kind, subject_key, last_seen_s FROM old WHERE acknowledged_s IS NULL ORDER BY last_seen_s DESC, kind, subject_key LIMIT 40")
def al_4(spark, sf_dir):
    old, _ = _alert_tables(spark, sf_dir)
    return old.where("acknowledged_s is null").orderBy(F.desc("last_seen_s"), "kind", "subject_key").limit(40).select("kind", "subject_key", "last_seen_s")


@query("al_5_acknowledge_first_wins", f"{_ALERTS} SELECT o.kind, o.subject_key, coalesce(o.acknowledged_s, n.last_seen_s) AS acknowledged_s FROM old o LEFT JOIN new n ON o.kind = n.kind AND o.subject_key = n.subject_key")
def al_5(spark, sf_dir):
    old, new = _alert_tables(spark, sf_dir)
    asked = new.select("kind", "subject_key", F.col("last_seen_s").alias("asked_s"))
    return old.join(asked, ["kind", "subject_key"], "left").select("kind", "subject_key", F.coalesce("acknowledged_s", "asked_s").alias("acknowledged_s"))


@query("ev_22_errors", "SELECT gold, count(*) OVER (PARTITION BY gold) AS errors, pair_id FROM (SELECT *, CAST(sim_score >= 0.6 AS INTEGER) AS hit FROM eval_pairs) WHERE hit <> gold")
def ev_22(spark, sf_dir):
    """One row for each wrongly called pair, with the number of errors under its gold label."""
    wrong = domain.eval_pairs(spark, sf_dir).where((F.col("sim_score") >= 0.6).cast("int") != F.col("gold")).select("gold", "pair_id")
    return wrong.join(wrong.groupBy("gold").agg(F.count("*").alias("errors")), "gold").select("gold", "errors", "pair_id")


@query("ev_27_extraction_metrics", f"SELECT tp, fp, fn, tn, {_PRF} FROM (SELECT count(*) FILTER (WHERE n > 1 AND quality = 1) AS tp, count(*) FILTER (WHERE n > 1 AND quality = 0) AS fp, count(*) FILTER (WHERE n <= 1 AND quality = 1) AS fn, count(*) FILTER (WHERE n <= 1 AND quality = 0) AS tn FROM (SELECT l.doc_id, l.quality, count(c.claim_id) AS n FROM labels l LEFT JOIN claims c ON c.article_id = l.doc_id GROUP BY ALL))")
def ev_27(spark, sf_dir):
    counts = domain.claims(spark, sf_dir).groupBy(F.col("article_id").alias("doc_id")).agg(F.count("*").alias("n"))
    rows = domain.table(spark, sf_dir, "labels").join(counts, "doc_id", "left").withColumn("hit", F.coalesce("n", F.lit(0)) > 1)
    of = lambda hit, q: F.count_if((F.col("hit") == hit) & (F.col("quality") == q))
    table = rows.agg(of(True, 1).alias("tp"), of(True, 0).alias("fp"), of(False, 1).alias("fn"), of(False, 0).alias("tn"))
    parts = {"precision": evaluation.ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": evaluation.ratio(F.col("tp"), F.col("tp") + F.col("fn")), "f1": evaluation.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))}
    return table.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(n) for n, c in parts.items()])


# ---------------------------------------------------------------- more text features


@query(
    "fn_16_keyword_phrases",
    f"""SELECT claim_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(regexp_replace(' ' || array_to_string(regexp_extract_all(lower(claim_text), '[a-z]+'), '  ') || ' ',
    ' ({"|".join(lex.STOP_WORDS)}) ', '|', 'g'), '|'), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> ''))), ',') AS phrases FROM claims""",
)
def fn_16(spark, sf_dir):
    return domain.claims(spark, sf_dir).select("claim_id", F.array_join(F.array_sort(tx.keyword_phrases(F.col("claim_text"))), ",").alias("phrases"))


@query("fn_26_score_kind", "SELECT claim_id, CASE WHEN verdict IS NULL THEN NULL WHEN claim_id % 2 = 0 THEN 'heuristic_score' ELSE 'legacy_unverified' END AS kind FROM claims")
def fn_26(spark, sf_dir):
    current = F.col("claim_id") % 2 == 0
    return domain.claims(spark, sf_dir).select("claim_id", F.when(F.col("verdict").isNotNull(), F.when(current, "heuristic_score").otherwise("legacy_unverified")).alias("kind"))


@query("fn_28_ground_truth", "SELECT claim_id, CASE WHEN verdict IN ('SUPPORTED', 'PARTIALLY_SUPPORTED') THEN 'SUPPORTS' WHEN verdict = 'DISPUTED' THEN 'REFUTES' WHEN verdict IS NOT NULL THEN 'NOT ENOUGH INFO' END AS target FROM claims")
def fn_28(spark, sf_dir):
    return domain.claims(spark, sf_dir).select("claim_id", tx.three_classes(F.col("verdict")).alias("target"))


@query(
    "fn_20_ngram_tfidf",
    r""", word AS (SELECT item_id AS pair_id, ' ' || unnest(list_filter(string_split_regex(lower(text), '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+'), lambda x: x <> '')) || ' ' AS t FROM benchmark),
    g AS (SELECT pair_id, substr(t, i, n) AS x FROM word, (VALUES (3), (4), (5)) size(n), LATERAL (SELECT unnest(range(1, length(t) - n + 2)) AS i)),
    tf AS (SELECT pair_id, x, 1 + ln(count(*)) AS tf FROM g GROUP BY ALL), idf AS (SELECT x, ln((1 + (SELECT count(DISTINCT pair_id) FROM g)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY x),
    w AS (SELECT pair_id, x, tf * idf AS w FROM tf JOIN idf USING (x)), n AS (SELECT pair_id, sqrt(sum(w * w)) AS n FROM w GROUP BY pair_id)
    SELECT a.pair_id AS a, b.pair_id AS b, round(sum(a.w * b.w) / (max(na.n) * max(nb.n)), 5) AS score FROM w a JOIN w b ON a.x = b.x AND b.pair_id = a.pair_id + 1 JOIN n na ON na.pair_id = a.pair_id JOIN n nb ON nb.pair_id = b.pair_id GROUP BY ALL""",
)
def fn_20(spark, sf_dir):
    rows = domain.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    weights = features.ngram_tfidf(rows, 3, 5)
    pairs = rows.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return features.sparse_cosine(weights, pairs).select("a", "b", F.round("score", 5).alias("score"))


_AT = "to_timestamp(at_s)::TIMESTAMP"
#: How an event's time is written in its payload, by event_id % 12: (Spark's pattern or expression, the time that can be read back).
_WRITTEN = [
    ("'{}'", "at_s", "at_s"),
    ("concat('{\"created_utc\":', at_s, '}')", None, "at_s"),
    ("concat('{\"created_utc\":', at_s, '.75}')", None, "at_s"),
    ("concat('{\"publishedAt\":\"', date_format(t, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), '\"}')", None, "at_s"),
    ("concat('{\"publishedAt\":\"soon\",\"pubDate\":\"', date_format(t, 'EEE, dd MMM yyyy HH:mm:ss'), ' GMT\"}')", None, "at_s"),
    ("concat('{\"published\":\"', date_format(t, \"yyyy-MM-dd'T'HH:mm:ss\"), '+02:00\"}')", None, "at_s - 7200"),
    ("concat('{\"publishedAt\":\"\",\"date\":\"', date_format(t, 'yyyy-MM-dd'), '\"}')", None, "at_s - at_s % 86400"),
    ("concat('{\"date\":\"', date_format(t, 'MMM d, yyyy'), '\"}')", None, "at_s - at_s % 86400"),
    ("concat('{\"pubDate\":\"', date_format(t, 'd MMM yyyy HH:mm:ss'), ' -0530\",\"date\":\"1999-01-01\"}')", None, "at_s + 19800"),
    ("concat('{\"date\":\"', date_format(t, 'yyyy-MM-dd HH:mm:ss'), '\"}')", None, "at_s"),
    ("concat('{\"date\":\"', event_id, '\",\"published\":null,\"created_utc\":0}')", None, "NULL"),
    ("props", None, "NULL"),
]


def _written_times(spark, sf_dir, of=None):
    """(event_id, payload, known): each event's time as a feed would write it; every twelfth has it already. of: the event_ids, if not all."""
    payload = F.expr("case event_id % 12 " + " ".join(f"when {k} then {written}" for k, (written, *_) in enumerate(_WRITTEN)) + " end")
    rows = domain.events(spark, sf_dir) if of is None else domain.events(spark, sf_dir).join(of, "event_id", "left_semi")
    timed = rows.withColumn("t", F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, at_s)"))
    return timed.select("event_id", payload.alias("payload"), F.when(F.col("event_id") % 12 == 0, F.col("at_s")).alias("known"))


@query("fn_7_published_repair", "SELECT event_id, CAST(CASE event_id % 12 " + " ".join(f"WHEN {k} THEN {known or read}" for k, (_, known, read) in enumerate(_WRITTEN)) + " END AS BIGINT) AS published_s FROM ev")
def fn_7(spark, sf_dir):
    """Each event's time is written into a payload in one of the feeds' ways and read back from it; one kind has it already."""
    return _written_times(spark, sf_dir).select("event_id", tx.repaired_time(F.col("known"), F.col("payload")).alias("published_s"))


# ---------------------------------------------------------------- graphs, evaluation and status


@query("gr_2_hub_timelines", f", {_BOTH}, d AS (SELECT a AS node FROM both_ways GROUP BY a HAVING count(*) >= 3), m AS (SELECT node, b AS member, published_s, row_number() OVER (PARTITION BY node ORDER BY published_s DESC NULLS LAST, b) AS r FROM both_ways JOIN d ON a = node JOIN articles ON article_id = b) SELECT node, string_agg(member::VARCHAR, ',' ORDER BY r) AS members, max(published_s) AS newest_s FROM m WHERE r <= 8 GROUP BY node")
def gr_2(spark, sf_dir):
    return graph.hub_timelines(domain.article_edges(spark, sf_dir), domain.articles(spark, sf_dir), 3, 8)


@query(
    "gr_11_claim_graph",
    """, top AS (SELECT claim_id FROM claims WHERE verdict IS NOT NULL ORDER BY confidence DESC NULLS LAST, claim_id LIMIT 400)
    SELECT from_id, to_id, kind, 'persisted' AS source FROM relations WHERE from_id IN (SELECT claim_id FROM top) AND to_id IN (SELECT claim_id FROM top)""",
)
def gr_11(spark, sf_dir):
    top = domain.claims(spark, sf_dir).where("verdict is not null").orderBy(F.col("confidence").desc_nulls_last(), "claim_id").limit(400).select("claim_id")
    rows = domain.relations(spark, sf_dir).join(top.toDF("from_id"), "from_id", "left_semi").join(top.toDF("to_id"), "to_id", "left_semi")
    return rows.select("from_id", "to_id", "kind", F.lit("persisted").alias("source"))


@query("gr_7_syndication_groups")
def gr_7(spark, sf_dir):
    rows = domain.articles(spark, sf_dir).select("article_id", "content_hash", tx.identity_key(F.col("content")).alias("body"))
    return graph.token_components(rows, "article_id", ["content_hash", "body"])


@query(
    "ev_8_bootstrap_mean",
    """, n AS (SELECT *, row_number() OVER (ORDER BY pair_id) - 1 AS i, count(*) OVER () AS total FROM eval_pairs),
    d AS (SELECT b, CAST(('0x' || substr(md5('s:' || b || ':' || i), 1, 8))::UBIGINT % total AS BIGINT) AS pick FROM n, (SELECT unnest(range(50)) AS b)),
    m AS (SELECT b, avg(n.gold) AS m FROM d JOIN n ON n.i = d.pick GROUP BY b)
    SELECT round(min(CASE WHEN r = 2 THEN m END), 6) AS low, round(min(CASE WHEN r = 49 THEN m END), 6) AS high FROM (SELECT m, row_number() OVER (ORDER BY m) AS r FROM m)""",
)
def ev_8(spark, sf_dir):
    return evaluation.bootstrap_mean(domain.eval_pairs(spark, sf_dir), "gold", "pair_id", 50, "s")


@query(
    "ev_15_record_quarantine",
    """SELECT pair_id, concat_ws(',', CASE WHEN sim_score < 0.05 THEN 'score' END, CASE WHEN event_group % 7 = 0 THEN 'event' END, CASE WHEN gold NOT IN (0, 1) THEN 'gold' END) AS reasons FROM eval_pairs WHERE sim_score < 0.05 OR event_group % 7 = 0 OR gold NOT IN (0, 1)""",
)
def ev_15(spark, sf_dir):
    rules = {"score": F.col("sim_score") < 0.05, "event": F.col("event_group") % 7 == 0, "gold": ~F.col("gold").isin(0, 1)}
    return evaluation.quarantine(domain.eval_pairs(spark, sf_dir), rules).select("pair_id", "reasons")


@query("ev_16_groups_across_splits", "SELECT event_group, count(DISTINCT split) AS splits FROM eval_pairs GROUP BY event_group HAVING count(DISTINCT split) > 1")
def ev_16(spark, sf_dir):
    return evaluation.leaking_groups(domain.eval_pairs(spark, sf_dir), "event_group", "split")


@query("ev_19_multilabel_scores", """, t AS (SELECT pair_id, unnest(CASE WHEN gold = 1 THEN ['A', 'B'] ELSE ['C'] END) AS t FROM eval_pairs), p AS (SELECT pair_id, unnest(CASE WHEN sim_score >= 0.6 THEN ['A'] ELSE ['B', 'C'] END) AS t FROM eval_pairs),
    j AS (SELECT coalesce(t.t, p.t) AS label, t.t IS NOT NULL AND p.t IS NOT NULL AS hit, p.t IS NULL AS miss, t.t IS NULL AS extra FROM t FULL JOIN p ON t.pair_id = p.pair_id AND t.t = p.t)
    SELECT label, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1 FROM (SELECT label, count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE extra) AS fp, count(*) FILTER (WHERE miss) AS fn FROM j GROUP BY label)""")
def ev_19(spark, sf_dir):
    rows = domain.eval_pairs(spark, sf_dir)
    truth = rows.select("pair_id", F.explode(F.when(F.col("gold") == 1, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("C")))).alias("label"))
    found = rows.select("pair_id", F.explode(F.when(F.col("sim_score") >= 0.6, F.array(F.lit("A"))).otherwise(F.array(F.lit("B"), F.lit("C")))).alias("label"))
    return evaluation.multilabel_scores(truth, found, "pair_id")


@query("ev_14_progress", "SELECT split, count(*) AS pairs, count(v.pair_id) AS labelled, count(c.pair_id) AS consensus FROM eval_pairs p LEFT JOIN (SELECT DISTINCT pair_id FROM votes) v USING (pair_id) LEFT JOIN (SELECT pair_id FROM votes WHERE origin = 'HUMAN' GROUP BY pair_id HAVING count(DISTINCT annotator) >= 2 AND min(label) = max(label)) c USING (pair_id) GROUP BY split")
def ev_14(spark, sf_dir):
    pairs, votes = domain.eval_pairs(spark, sf_dir), domain.votes(spark, sf_dir)
    agreed = evaluation.human_consensus(votes).select("pair_id", F.lit(1).alias("agreed"))
    seen = votes.select("pair_id").distinct().withColumn("voted", F.lit(1))
    joined = pairs.join(seen, "pair_id", "left").join(agreed, "pair_id", "left")
    return joined.groupBy("split").agg(F.count("*").alias("pairs"), F.count("voted").alias("labelled"), F.count("agreed").alias("consensus"))


@query(
    "ev_25_weak_lexical_label",
    f"""SELECT from_id, to_id, CASE WHEN j >= 0.4 THEN 'SAME_STORY' WHEN j >= 0.2 THEN 'EVOLVED' ELSE 'DISTINCT' END AS label FROM (SELECT from_id, to_id, CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE ELSE 0.0 END AS j
    FROM (SELECT r.from_id, r.to_id, {_SET.format("a.claim_text")} AS x, {_SET.format("b.claim_text")} AS y FROM relations r JOIN claims a ON a.claim_id = r.from_id JOIN claims b ON b.claim_id = r.to_id))""",
)
def ev_25(spark, sf_dir):
    score = F.col("jaccard")
    return fn_17(spark, sf_dir).select("from_id", "to_id", F.when(score >= 0.4, "SAME_STORY").when(score >= 0.2, "EVOLVED").otherwise("DISTINCT").alias("label"))


@query("ev_26_export_records", "SELECT p.pair_id, p.split, p.gold, count(v.pair_id) AS n_votes, coalesce(string_agg(v.annotator || '=' || v.label, ',' ORDER BY v.annotator), '') AS votes FROM eval_pairs p LEFT JOIN votes v USING (pair_id) GROUP BY ALL")
def ev_26(spark, sf_dir):
    lists = domain.votes(spark, sf_dir).groupBy("pair_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.concat("annotator", F.lit("="), "label"))).alias("v"))
    rows = domain.eval_pairs(spark, sf_dir).join(lists, "pair_id", "left")
    return rows.select("pair_id", "split", "gold", F.coalesce("n", F.lit(0)).alias("n_votes"), F.coalesce(F.array_join("v", ","), F.lit("")).alias("votes"))


@query("agg_11_claim_dossier", _ENT + " SELECT c.claim_id, c.verdict, coalesce(string_agg(e.e.k || ':' || e.e.t, ',' ORDER BY e.e.k || ':' || e.e.t), '') AS entities FROM claims c LEFT JOIN ent e USING (claim_id) GROUP BY ALL")
def agg_11(spark, sf_dir):
    rows = domain.claims(spark, sf_dir)
    lists = verdicts.entity_rows(rows).groupBy("claim_id").agg(F.sort_array(F.collect_list(F.concat("entity_type", F.lit(":"), "entity_text"))).alias("e"))
    return rows.select("claim_id", "verdict").join(lists, "claim_id", "left").select("claim_id", "verdict", F.coalesce(F.array_join("e", ","), F.lit("")).alias("entities"))


@query("agg_16_collection_summary", "SELECT domain, count(*) AS fetched, count(*) FILTER (WHERE first) AS inserted FROM (SELECT domain, row_number() OVER (PARTITION BY url ORDER BY article_id) = 1 AS first FROM articles) GROUP BY domain")
def agg_16(spark, sf_dir):
    from pyspark.sql import Window as W

    first = F.row_number().over(W.partitionBy("url").orderBy("article_id")) == 1
    return domain.articles(spark, sf_dir).select("domain", first.alias("first")).groupBy("domain").agg(F.count("*").alias("fetched"), F.count_if(F.col("first")).alias("inserted"))


_REFUSED = """'HTTP 503:' || chr(10) || '  ' || domain || ' is away'"""


@query(
    "agg_16_whole_summary",
    f""", failed AS (SELECT DISTINCT domain, 'Failed - ' || regexp_replace({_REFUSED}, '\\s+', ' ', 'g') AS error FROM articles WHERE length(domain) % 4 = 1),
    kept AS (SELECT * FROM articles WHERE domain NOT IN (SELECT domain FROM failed)),
    placed AS (SELECT domain, url IS NOT NULL AND row_number() OVER (PARTITION BY url ORDER BY article_id) = 1 AS first FROM kept)
    SELECT domain AS source, count(*) AS fetched, count(*) FILTER (WHERE first) AS inserted, NULL::VARCHAR AS error FROM placed GROUP BY domain UNION ALL SELECT domain, 0, 0, error FROM failed""",
)
def agg_16_whole(spark, sf_dir):
    """What each source brought, and why the others failed: here, for want of a log, those with names of certain lengths."""
    rows = domain.articles(spark, sf_dir).select(F.col("domain").alias("source"), "url", F.col("article_id").alias("id"))
    failures = rows.where("length(source) % 4 = 1").select("source", F.expr(_REFUSED.replace("domain", "source")).alias("error")).distinct()
    return agg.collection_summary(rows, failures)


@query("agg_18_corpus_snapshot", "SELECT (SELECT count(*) FROM articles) AS articles, (SELECT count(*) FROM claims) AS claims, (SELECT count(*) FROM relations WHERE kind = 'EVOLVED_FROM') AS evolved, (SELECT count(*) FROM relations WHERE kind = 'SIMILAR_TO') AS similar, (SELECT max(published_s) FROM articles) AS last_s")
def agg_18(spark, sf_dir):
    edges = domain.relations(spark, sf_dir).agg(F.count_if(F.col("kind") == "EVOLVED_FROM").alias("evolved"), F.count_if(F.col("kind") == "SIMILAR_TO").alias("similar"))
    articles = domain.articles(spark, sf_dir).agg(F.count("*").alias("articles"), F.max("published_s").alias("last_s"))
    return articles.crossJoin(domain.claims(spark, sf_dir).agg(F.count("*").alias("claims"))).crossJoin(edges)


@query("pl_2_claim_extraction", "SELECT article_id, count(*) AS claims, round(max(confidence), 2) AS best FROM claims WHERE confidence >= 0.5 GROUP BY article_id")
def pl_2(spark, sf_dir):
    return domain.claims(spark, sf_dir).where("confidence >= 0.5").groupBy("article_id").agg(F.count("*").alias("claims"), F.round(F.max("confidence"), 2).alias("best"))


@query("pl_4_cycle_guard", f"SELECT n, fresh, CASE WHEN n < 30 THEN 'corpus_too_small' WHEN fresh < 10 THEN 'nothing_new' ELSE 'run' END AS status FROM (SELECT count(*) AS n, count(*) FILTER (WHERE extracted_s > {_NOW} - 86400) AS fresh FROM claims)")
def pl_4(spark, sf_dir):
    now = _now(spark, sf_dir)
    rows = domain.claims(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("extracted_s") > now - 86_400).alias("fresh"))
    return rows.withColumn("status", F.when(F.col("n") < 30, "corpus_too_small").when(F.col("fresh") < 10, "nothing_new").otherwise("run"))


@query("st_3_daily_counts", "SELECT (at_s // 86400) * 86400 AS day_s, event_type, count(*) AS n FROM ev GROUP BY ALL")
def st_3(spark, sf_dir):
    """The stream of events drained into daily counts; SQL counts the same table at once."""
    stream = jobs.event_stream(spark, sf_dir, "event_id long, ts timestamp_ntz, user_id long, event_type string", name="events.parquet")
    rows = jobs.drain(jobs.windowed_counts(stream, ["event_type"], "24 hours"), "complete", "daily")
    return rows.select(F.unix_seconds("start").alias("day_s"), "event_type", "n")


# ---------------------------------------------------------------- language, diffs, models and evidence


def _language_case() -> str:
    counts = ", ".join("{'n': len(list_filter(w, lambda x: x IN (" + _in(v) + "))), 'o': -" + str(i) + ", 'lang': '" + k + "'}" for i, (k, v) in enumerate(sorted(tx.LANGUAGE_WORDS.items())))
    return f"list_max([{counts}])"


@query("fn_9_language_by_words", rf"SELECT doc_id, CASE WHEN length(trim(text)) >= 20 AND b.n > 0 THEN b.lang END AS language FROM (SELECT doc_id, text, {_language_case()} AS b FROM (SELECT doc_id, text, string_split_regex(lower(text), '[\s.,;:!?]+') AS w FROM documents))")
def fn_9(spark, sf_dir):
    return domain.table(spark, sf_dir, "documents").select("doc_id", tx.language_by_words(F.col("text")).alias("language"))


_ENTITY_SET = "list_distinct(list_filter(regexp_extract_all({}, '" + _TOKEN + "'), lambda t: regexp_matches(t, '^([A-Z][a-zA-Z]{{2,}}|[A-Z]{{2}})$') AND lower(t) NOT IN (" + _in(_COMMON) + ")))"


@query(
    "fn_18_entity_jaccard",
    f""", two AS (SELECT r.from_id, r.to_id, {_ENTITY_SET.format("x.claim_text")} AS x, {_ENTITY_SET.format("y.claim_text")} AS y FROM relations r JOIN claims x ON x.claim_id = r.from_id JOIN claims y ON y.claim_id = r.to_id)
    SELECT from_id, to_id, CASE WHEN len(x) + len(y) > 0 THEN len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE END AS jaccard FROM two""",
)
def fn_18(spark, sf_dir):
    text = domain.claims(spark, sf_dir).select("claim_id", "claim_text")
    pairs = domain.relations(spark, sf_dir).select("from_id", "to_id").join(text.toDF("from_id", "x"), "from_id").join(text.toDF("to_id", "y"), "to_id")
    return pairs.select("from_id", "to_id", tx.entity_jaccard(F.col("x"), F.col("y")).alias("jaccard"))


_SEVERE = "CASE length(kind) % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'INFO' END"


@query("al_4_filtered_feed", f"{_ALERTS} SELECT kind, {_SEVERE} AS severity, subject_key, last_seen_s FROM old WHERE {_SEVERE} = 'WARNING' ORDER BY last_seen_s DESC, kind, subject_key LIMIT 30")
def al_4_filtered(spark, sf_dir):
    """Alerts of one severity (a stand-in by the kind's length), acknowledged ones too, newest first."""
    old, _ = _alert_tables(spark, sf_dir)
    return alerts.feed(old.withColumn("severity", F.expr(_SEVERE)), 30, severity="warning", include_acknowledged=True).select("kind", "severity", "subject_key", "last_seen_s")


@query(
    "al_4_tallies",
    f"""{_ALERTS}, waiting AS (SELECT kind, {_SEVERE} AS severity FROM old WHERE acknowledged_s IS NULL)
    SELECT 'all' AS part, 'unacknowledged' AS name, count(*) AS n FROM waiting HAVING count(*) > 0 UNION ALL SELECT 'severity', severity, count(*) FROM waiting GROUP BY severity UNION ALL SELECT 'kind', kind, count(*) FROM waiting GROUP BY kind""",
)
def al_4_tallies(spark, sf_dir):
    old, _ = _alert_tables(spark, sf_dir)
    return alerts.tallies(old.withColumn("severity", F.expr(_SEVERE)))


@query(
    "gr_7_named_groups",
    r""", row AS (SELECT article_id, CASE WHEN article_id % 9 = 4 THEN article_id - 4 END AS canonical_id, CASE WHEN article_id % 4 > 0 THEN content_hash END AS content_hash,
      CASE WHEN length(trim(regexp_replace(lower(content), '\s+', ' ', 'g'))) >= 80 THEN sha256(trim(regexp_replace(lower(content), '\s+', ' ', 'g'))) END AS body FROM articles),
    token AS (SELECT article_id AS id, unnest(['article:' || article_id, 'article:' || canonical_id, 'hash:' || content_hash, 'body:' || body]) AS t FROM row),
    star AS (SELECT id AS a, min(id) OVER (PARTITION BY t) AS b FROM token WHERE t IS NOT NULL), link AS (SELECT a, b FROM star UNION SELECT b, a FROM star),
    comp AS (WITH RECURSIVE w AS (SELECT DISTINCT a AS node, a AS seen FROM link UNION SELECT w.node, l.b FROM w JOIN link l ON l.a = w.seen) SELECT node AS article_id, min(seen) AS component FROM w GROUP BY node)
    SELECT article_id, component, coalesce('canonical:' || min(canonical_id) OVER g, 'content:' || min(content_hash) OVER g, 'article:' || min(article_id) OVER g) AS name FROM comp JOIN row USING (article_id) WINDOW g AS (PARTITION BY component)""",
)
def gr_7_named(spark, sf_dir):
    """Some articles copy the one four before them, and a quarter has no hash."""
    canonical = F.when(F.col("article_id") % 9 == 4, F.col("article_id") - 4)
    rows = domain.articles(spark, sf_dir).select("article_id", canonical.alias("canonical_id"), F.when(F.col("article_id") % 4 > 0, F.col("content_hash")).alias("content_hash"), tx.identity_key(F.col("content")).alias("body"))
    return graph.syndication_groups(rows)


@query(
    "gr_10_around_titles",
    """, wanted AS (SELECT article_id AS node FROM articles WHERE contains(lower(title), 'tion')), near AS (SELECT node FROM wanted UNION SELECT b FROM article_edges JOIN wanted ON a = node UNION SELECT a FROM article_edges JOIN wanted ON b = node)
    SELECT a, b, score FROM article_edges WHERE a IN (SELECT node FROM near) AND b IN (SELECT node FROM near)""",
)
def gr_10_titles(spark, sf_dir):
    nodes = domain.articles(spark, sf_dir).where(F.contains(F.lower("title"), F.lit("tion"))).select(F.col("article_id").alias("node"))
    return graph.around(domain.article_edges(spark, sf_dir), nodes)


@query(
    "fn_3_markup_scrub",
    r"""SELECT page_id, cleaned, length(cleaned) >= 25 AND contains(cleaned, ' ') AND NOT regexp_matches(lower(cleaned), '^(http|more|read)') AS kept FROM (
    SELECT page_id, substr(trim(regexp_replace(regexp_replace(html, '<[^a-z/!]|</?[a-z][^>]*>', ' ', 'g'), '\s+', ' ', 'g')), 1, 500) AS cleaned FROM pages WHERE contains(html, '<')) WHERE cleaned <> ''""",
)
def fn_3(spark, sf_dir):
    rows = domain.table(spark, sf_dir, "pages").where(F.contains("html", F.lit("<"))).select("page_id", tx.display_text(F.col("html"), 500).alias("cleaned")).where("cleaned is not null")
    kept = (F.length("cleaned") >= 25) & F.contains("cleaned", F.lit(" ")) & ~F.lower("cleaned").rlike("^(http|more|read)")
    return rows.withColumn("kept", kept)


@query("win_4_top_neighbours", f"SELECT q, id, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS r FROM (SELECT x.vec_id AS q, y.vec_id AS id, {_COS.format('x.embedding', 'y.embedding')} AS score FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 100 = 0)) WHERE r <= 3")
def win_4(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    found = vectors.nearest(rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 3)
    return found.select("q", "id", "place")


@query("win_10_capped_pairs")
def win_10(spark, sf_dir):
    return ranking.capped_pairs(domain.article_edges(spark, sf_dir), [F.desc("score"), "a", "b"], 2)


@query("gr_4_lineage_hops", """, e AS (SELECT from_id AS a, to_id AS b FROM relations WHERE kind = 'EVOLVED_FROM' UNION ALL SELECT to_id, from_id FROM relations WHERE kind = 'EVOLVED_FROM'),
    h0 AS (SELECT claim_id AS root, claim_id AS node FROM claims), h1 AS (SELECT DISTINCT root, b AS node FROM h0 JOIN e ON a = node), h2 AS (SELECT DISTINCT root, b AS node FROM h1 JOIN e ON a = node), h3 AS (SELECT DISTINCT root, b AS node FROM h2 JOIN e ON a = node)
    SELECT root, node, min(hop) AS hop FROM (SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3) GROUP BY ALL""")
def gr_4(spark, sf_dir):
    edges = domain.relations(spark, sf_dir).where("kind = 'EVOLVED_FROM'").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    roots = domain.claims(spark, sf_dir).select(F.col("claim_id").alias("root"))
    return graph.within_hops(edges, roots, 3)


_CURVE = """
{m}_tie AS (SELECT b, {m} AS score, sum(times * gold) AS p, sum(times * (1 - gold)) AS n FROM drawn JOIN scored USING (event_group) GROUP BY b, {m}),
{m}_run AS (SELECT *, sum(p) OVER up AS tp, sum(n) OVER up AS fp, sum(p) OVER (PARTITION BY b) AS all_p, sum(n) OVER (PARTITION BY b) AS all_n FROM {m}_tie WINDOW up AS (PARTITION BY b ORDER BY score DESC)),
{m}_curve AS (SELECT b, sum(p * (all_n - fp + n / 2.0::DOUBLE)) / any_value(all_p * all_n)::DOUBLE AS auroc, sum(CASE WHEN tp + fp > 0 THEN p * (tp / (tp + fp)::DOUBLE) ELSE 0 END) / any_value(all_p)::DOUBLE AS auprc,
  2 * sum(p) FILTER (score >= {at}) / (sum(p + n) FILTER (score >= {at}) + any_value(all_p))::DOUBLE AS f1 FROM {m}_run WHERE all_p > 0 AND all_n > 0 GROUP BY b)"""


@query(
    "ev_9_group_bootstrap",
    f""", scored AS (SELECT event_group, gold, sim_score AS first, floor((sim_score * 600 + (('0x' || substr(md5(CAST(pair_id * 17 + 3 AS VARCHAR)), 1, 8))::UBIGINT % 1000) * 0.4::DOUBLE) / 25) / 40 AS second FROM eval_pairs WHERE gold IS NOT NULL),
    numbered AS (SELECT event_group, row_number() OVER (ORDER BY event_group) - 1 AS i, count(*) OVER () AS total FROM (SELECT DISTINCT event_group FROM scored)),
    pick AS (SELECT b, CAST(('0x' || substr(md5('g:' || b || ':' || i), 1, 8))::UBIGINT % total AS BIGINT) AS i FROM numbered, (SELECT unnest(range(40)) AS b)),
    drawn AS (SELECT b, event_group, count(*) AS times FROM pick JOIN numbered USING (i) GROUP BY ALL UNION ALL SELECT -1, event_group, 1 FROM numbered),
    {_CURVE.format(m="first", at=0.5)}, {_CURVE.format(m="second", at=0.6)},
    d AS (SELECT f.b, unnest(['auroc', 'auprc', 'f1']) AS metric, unnest([f.auroc - s.auroc, f.auprc - s.auprc, coalesce(f.f1, 0) - coalesce(s.f1, 0)]) AS d FROM first_curve f JOIN second_curve s USING (b))
    SELECT metric, round(max(d) FILTER (b < 0), 6) AS observed, round(quantile_cont(d, 0.025) FILTER (b >= 0), 6) AS low, round(quantile_cont(d, 0.975) FILTER (b >= 0), 6) AS high, round(avg(d) FILTER (b >= 0), 6) AS mean, count(*) FILTER (b >= 0) AS valid FROM d GROUP BY metric""",
)
def ev_9(spark, sf_dir):
    """The pairs' score, threshold .5, against a rougher one in steps of a fortieth, threshold .6."""
    rough = F.floor((F.col("sim_score") * 600 + domain.draw(F.col("pair_id") * 17 + 3) * 0.4) / 25) / 40
    rows = domain.eval_pairs(spark, sf_dir).withColumn("rough", rough)
    return evaluation.group_bootstrap(rows, "event_group", ("sim_score", 0.5), ("rough", 0.6), 40, "g")


@query("ev_13_report", "SELECT bucket, count(*) AS pairs, sum(gold) AS positives, round(avg(sim_score), 6) AS mean_score FROM (SELECT *, CASE WHEN sim_score >= 0.95 THEN 'b95' WHEN sim_score >= 0.85 THEN 'b85' WHEN sim_score >= 0.75 THEN 'b75' WHEN sim_score >= 0.6 THEN 'b60' WHEN sim_score >= 0.4 THEN 'b40' ELSE 'b00' END AS bucket FROM eval_pairs) GROUP BY bucket")
def ev_13(spark, sf_dir):
    rows = domain.eval_pairs(spark, sf_dir).groupBy(tx.similarity_bucket(F.col("sim_score")).alias("bucket"))
    return rows.agg(F.count("*").alias("pairs"), F.sum("gold").alias("positives"), F.round(F.avg("sim_score"), 6).alias("mean_score"))


@query("ev_17_moved_groups", "SELECT event_group, split, assigned FROM (SELECT DISTINCT event_group, split FROM eval_pairs) LEFT JOIN (SELECT DISTINCT event_group, CASE WHEN event_group % 5 = 0 THEN 'test' ELSE split END AS assigned FROM eval_pairs WHERE event_group % 7 <> 0) USING (event_group) WHERE split IS DISTINCT FROM assigned")
def ev_17(spark, sf_dir):
    rows = domain.eval_pairs(spark, sf_dir)
    assigned = rows.where("event_group % 7 <> 0").select("event_group", F.when(F.col("event_group") % 5 == 0, "test").otherwise(F.col("split")).alias("split")).distinct()
    return evaluation.moved_groups(rows, assigned, "event_group", "split")


@query("ev_18_calibrated_logistic")
def ev_18(spark, sf_dir):
    size = domain.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.log(F.col("n_chars") + 1).alias("size"))
    rows = domain.eval_pairs(spark, sf_dir).join(size, "pair_id", "left")
    return modelling.calibrated_logistic(rows, ["sim_score", "size"]).select("pair_id", "split", "gold", F.round("score", 6).alias("score"))


@query("ev_21_signal_ablations")
def ev_21(spark, sf_dir):
    rows = staged_claims(spark, sf_dir, *CLAIM_FACTS)
    signals = verdicts.backing(verdicts.corroboration(rows, _evidence(spark, sf_dir, rows)))
    signals = signals.union(verdicts.track_record(rows, _priors(spark, sf_dir, rows)).select("claim_id", F.lit("track_record"), F.col("signal")))
    many = evaluation.ablations(signals, ["corroboration", "contradiction", "track_record"])
    pooled = verdicts.pool(many, ("ablation", "claim_id"))
    return pooled.groupBy("ablation").agg(F.count("*").alias("n"), F.round(F.avg("probability"), 6).alias("mean_probability"))


@query("ev_23_pair_classification", "SELECT gold, count(*) AS n, count(*) FILTER (WHERE sim_score >= 0.75) AS called FROM eval_pairs GROUP BY gold")
def ev_23(spark, sf_dir):
    return domain.eval_pairs(spark, sf_dir).groupBy("gold").agg(F.count("*").alias("n"), F.count_if(F.col("sim_score") >= 0.75).alias("called"))


@query("ev_24_stratified_sample", "SELECT bucket, pair_id FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(pair_id::VARCHAR || ':q'), pair_id) AS r FROM (SELECT pair_id, CASE WHEN sim_score >= 0.95 THEN 'b95' WHEN sim_score >= 0.85 THEN 'b85' WHEN sim_score >= 0.75 THEN 'b75' WHEN sim_score >= 0.6 THEN 'b60' WHEN sim_score >= 0.4 THEN 'b40' ELSE 'b00' END AS bucket FROM eval_pairs WHERE pair_id NOT IN (SELECT pair_id FROM votes WHERE origin = 'WEAK'))) WHERE r <= 8")
def ev_24(spark, sf_dir):
    from pyspark.sql import Window as W

    taken = domain.votes(spark, sf_dir).where("origin = 'WEAK'").select("pair_id")
    rows = domain.eval_pairs(spark, sf_dir).join(taken, "pair_id", "left_anti").select("pair_id", tx.similarity_bucket(F.col("sim_score")).alias("bucket"))
    order = W.partitionBy("bucket").orderBy(F.md5(F.concat(F.col("pair_id").cast("string"), F.lit(":q"))), "pair_id")
    return rows.withColumn("r", F.row_number().over(order)).where("r <= 8").select("bucket", "pair_id")


@query("pl_1_preprocess")
def pl_1(spark, sf_dir):
    rows = domain.untimed_articles(spark, sf_dir)
    canonical = _canonical(spark, sf_dir).withColumnRenamed("id", "article_id")
    done = rows.select("article_id", tx.word_count(tx.clean_markup(F.col("content"))).alias("n_words"), tx.url_authority(F.col("url")).alias("domain"), tx.language_by_words(F.col("content")).alias("language"))
    return done.join(canonical, "article_id").select("article_id", "domain", "language", "n_words", "canonical_id")


@query("pl_1_whole_preprocess")
def pl_1_whole(spark, sf_dir):
    """Each article cleaned in full, with language, host, words, its time as its payload has it, and the first of its near-duplicates."""
    rows = domain.untimed_articles(spark, sf_dir)
    canonical = stage(_canonical(spark, sf_dir).withColumnRenamed("id", "article_id"), "canonical")
    times = _written_times(spark, sf_dir, canonical.select(F.col("article_id").alias("event_id"))).select(F.col("event_id").alias("article_id"), tx.repaired_time(F.col("known"), F.col("payload")).alias("published_s"))
    cleaned = rows.select("article_id", "url", spans.clean_text("content").alias("cleaned")).withColumn("language", tx.language_by_words(F.col("cleaned")))
    facts = stage(canonical.join(times, "article_id", "left"), "article-facts")  # texts move once
    done = cleaned.join(facts, "article_id")
    return done.select("article_id", "cleaned", "language", tx.url_authority(F.col("url")).alias("domain"), tx.word_count(F.col("cleaned")).alias("n_words"), "published_s", "canonical_id")


@query("pl_3_topic_clusters")
def pl_3(spark, sf_dir):
    return modelling.topic_clusters(_vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 8)


@query("pl_6_token_differences")
def pl_6(spark, sf_dir):
    text = staged_claims(spark, sf_dir, "claim_id", "claim_text", "extracted_s")
    pairs = domain.relations(spark, sf_dir, text).select("from_id", "to_id")
    text = text.drop("extracted_s")
    return changes.token_differences(pairs.join(text.toDF("from_id", "b"), "from_id").join(text.toDF("to_id", "a"), "to_id"))


@query("pl_5_whole_changes")
def pl_5_whole(spark, sf_dir):
    """Changes of every relation's claims with ratio, spans, order in time and lag."""
    claims = staged_claims(spark, sf_dir, "claim_id", "claim_text", "published_s", "extracted_s")
    text = claims.drop("extracted_s")
    pairs = domain.relations(spark, sf_dir, claims).select("from_id", "to_id").join(text.toDF("from_id", "b", "newer_s"), "from_id").join(text.toDF("to_id", "a", "older_s"), "to_id")
    return changes.whole_changes(pairs)


@query("pl_13_pooled_probability")
def pl_13(spark, sf_dir):
    rows = staged_claims(spark, sf_dir, *CLAIM_FACTS)
    return verdicts.pool(verdicts.backing(verdicts.corroboration(rows, _evidence(spark, sf_dir, rows))))


@query("pl_16_vector_backfill")
def pl_16(spark, sf_dir):
    rows = domain.articles(spark, sf_dir).select(F.col("article_id").alias("id"), F.left(F.concat_ws(". ", "title", "content"), F.lit(2000)).alias("text"))
    found = modelling.hashed_vectors(rows, _vectors(spark, sf_dir).where("vec_id % 2 = 0").select(F.col("vec_id").alias("id")))
    return found.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("squared_norm"))
