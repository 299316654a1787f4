"""Queries of evidence checks, lineages, alert conditions and typed edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import lexicons as lex
from newsloom.operators import alerts, exports, inquiry, verdicts
from newsloom.plans import catalog
from newsloom.plans.catalog import query
from newsloom.plans.staging import stage
from newsloom.sources import domain

_WINDOW = 864_000


@query(
    "al_3_conditions",
    f"""{catalog._EVID}, {catalog.RELATION_PAIRS}, {catalog.change_sql("relation_pairs", "from_id, to_id, kind, created_s")},
    since AS (SELECT max(extracted_s) - {_WINDOW} AS s FROM claims), new AS (SELECT * FROM claims WHERE extracted_s >= (SELECT s FROM since)),
    backed AS (SELECT claim_id, extracted_s, CASE WHEN support + against > 0 AND against / (support + against)::DOUBLE >= 0.3 THEN 'CONTRADICTION' WHEN corroboration >= 0.6 THEN 'CORROBORATION' END AS kind FROM new JOIN corr USING (claim_id)),
    raised AS (SELECT 1 AS turn, -extracted_s AS sort, kind, CASE kind WHEN 'CONTRADICTION' THEN 'CRITICAL' ELSE 'INFO' END AS severity, 'claim:' || claim_id AS subject_key FROM backed WHERE kind IS NOT NULL
      UNION ALL SELECT 2, -created_s, 'MUTATION', CASE WHEN contains(types, 'NUMERIC_DRIFT') OR contains(types, 'POLARITY_SHIFT') THEN 'WARNING' ELSE 'INFO' END, 'edge:' || from_id || ':' || to_id FROM changed
        WHERE kind = 'EVOLVED_FROM' AND created_s >= (SELECT s FROM since) AND meaningful AND types <> ''
      UNION ALL SELECT 3, -count(*), 'SPIKE', 'WARNING', 'cluster:1:' || topic_id FROM new GROUP BY topic_id HAVING count(*) >= 8)
    SELECT kind, severity, subject_key FROM raised ORDER BY turn, sort, subject_key LIMIT 40""",
)
def al_3(spark, sf_dir):
    """The ten days before the last extraction."""
    claims = catalog.staged_claims(spark, sf_dir, *catalog.CLAIM_FACTS, "claim_text")
    since = (claims.agg(F.max("extracted_s")).first()[0] or 0) - _WINDOW
    backed = verdicts.corroboration(claims, catalog._evidence(spark, sf_dir, claims))
    ratio = F.when(F.col("support") + F.col("against") > 0, F.col("against") / (F.col("support") + F.col("against")))
    changes = catalog.relation_changes(spark, sf_dir, claims).where("kind = 'EVOLVED_FROM'")
    clusters = claims.select("claim_id", F.lit(1).alias("run"), F.col("topic_id").alias("topic"))
    return alerts.conditions(claims, backed.select("claim_id", ratio.alias("ratio"), "corroboration"), changes, clusters, since)


@query("snk_4_relationship_edges", f", {catalog.RELATION_PAIRS}, {catalog.change_sql('relation_pairs', 'from_id, to_id, kind')} SELECT kind, from_id AS child_claim_id, to_id AS parent_claim_id, CASE WHEN kind = 'EVOLVED_FROM' THEN types END AS mutation_types FROM changed")
def snk_4(spark, sf_dir):
    """Written with a folder for each kind of edge, and read back."""
    rows = catalog.relation_changes(spark, sf_dir)
    types = F.when(F.col("kind") == "EVOLVED_FROM", F.col("types")).alias("mutation_types")
    return exports.write_labelled(rows.select("kind", F.col("from_id").alias("child_claim_id"), F.col("to_id").alias("parent_claim_id"), types), "kind")


_BOTH = """, e0 AS (SELECT from_id AS a, to_id AS b, score FROM relations WHERE kind = 'EVOLVED_FROM' AND from_id <> to_id),
e AS (SELECT a, b, max(score) AS score FROM (SELECT * FROM e0 UNION ALL SELECT b, a, score FROM e0) GROUP BY a, b)"""


def _walk_sql(k: int) -> str:
    """The k-th level of the best-first walk and all levels up to it."""
    return f"""m{k} AS (SELECT * FROM (SELECT p.root, e.b AS node, p.pos, e.score, row_number() OVER (PARTITION BY p.root, e.b ORDER BY p.pos, e.score DESC) AS one
      FROM f{k - 1} p JOIN e ON e.a = p.node LEFT JOIN c{k - 1} s ON s.root = p.root AND s.node = e.b WHERE s.node IS NULL) WHERE one = 1),
    f{k} AS (SELECT root, node, pos FROM (SELECT m.root, m.node, n.n + row_number() OVER (PARTITION BY m.root ORDER BY m.pos, m.score DESC, m.node) AS pos FROM m{k} m JOIN (SELECT root, count(*) AS n FROM c{k - 1} GROUP BY root) n USING (root)) WHERE pos <= 12),
    c{k} AS (SELECT * FROM c{k - 1} UNION ALL SELECT * FROM f{k})"""


@query(
    "gr_4_bounded_lineage",
    f"""{_BOTH}, f0 AS (SELECT claim_id AS root, claim_id AS node, 1 AS pos FROM claims), c0 AS (SELECT * FROM f0), {_walk_sql(1)}, {_walk_sql(2)}, {_walk_sql(3)},
    h0 AS (SELECT claim_id AS root, claim_id AS node FROM claims), h1 AS (SELECT DISTINCT root, b AS node FROM h0 JOIN e ON a = node), h2 AS (SELECT DISTINCT root, b AS node FROM h1 JOIN e ON a = node), h3 AS (SELECT DISTINCT root, b AS node FROM h2 JOIN e ON a = node),
    hops AS (SELECT root, node, min(hop) AS hop FROM (SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3) GROUP BY ALL),
    size AS (SELECT root, count(*) AS within, max(hop) AS far FROM hops GROUP BY root), kept AS (SELECT root, count(*) AS kept FROM c3 GROUP BY root)
    SELECT c.root, c.node, row_number() OVER (PARTITION BY c.root ORDER BY k.published_s NULLS LAST, c.node) AS place, within > kept OR within >= 400 OR far = 3 AS truncated
    FROM c3 c JOIN size USING (root) JOIN kept USING (root) JOIN claims k ON k.claim_id = c.node WHERE within > 1""",
)
def gr_4(spark, sf_dir):
    """Every claim is a root."""
    edges = domain.relations(spark, sf_dir).where("kind = 'EVOLVED_FROM'").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "score")
    claims = domain.claims(spark, sf_dir)
    return inquiry.lineages(edges, claims.select(F.col("claim_id").alias("node"), "published_s"), claims.select(F.col("claim_id").alias("root")))


def _words_sql(column: str) -> str:
    """Sorted words of polarity and numbers of a text, each as a list."""
    tokens = f"regexp_extract_all(lower({column}), '{catalog._TOKEN}')"
    return f"list_sort(list_filter({tokens}, lambda x: x IN ({catalog._in(lex.POLARITY_WORDS)}))), list_sort(list_filter({tokens}, lambda x: regexp_matches(x, '^[+\\-]?\\$?[0-9]')))"


_SHARED = f"len(list_intersect({catalog._SET.format('q_text')}, {catalog._SET.format('text')}))"
_UNION = f"len(list_distinct(list_concat({catalog._SET.format('q_text')}, {catalog._SET.format('text')})))"
_STANCE = f"""CASE WHEN {_UNION} = 0 OR {_SHARED} / {_UNION}::DOUBLE < 0.1 THEN 'neutral' WHEN ({_words_sql('q_text')}) <> ({_words_sql('text')}) THEN 'contradiction' ELSE 'entailment' END"""


@query(
    "pl_10_claim_check",
    f""", origin AS (SELECT article_id, min(article_id) OVER (PARTITION BY content_hash) AS origin FROM articles),
    base AS (SELECT c.claim_id AS id, v.embedding AS v, c.domain, o.origin, c.published_s, a.collected_s, c.extracted_s, c.claim_text AS text FROM embeddings v JOIN claims c ON c.article_id = v.vec_id JOIN articles a ON a.article_id = c.article_id JOIN origin o ON o.article_id = c.article_id WHERE v.embedding IS NOT NULL),
    held AS (SELECT * FROM base WHERE extracted_s <= {catalog._NOW} AND collected_s <= {catalog._NOW} AND coalesce(published_s <= {catalog._NOW}, TRUE)),
    asked AS (SELECT id AS q, v AS qv, domain AS own_domain, origin AS own_origin, text AS q_text FROM base WHERE id % 100 = 0),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS r FROM (SELECT a.q, a.own_domain, a.own_origin, a.q_text, h.id, h.domain, h.origin, h.published_s, h.text, {catalog._COS.format("a.qv", "h.v")} AS score FROM asked a JOIN held h ON h.id <> a.q)) WHERE r <= 48 AND score >= 0.1),
    once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, origin ORDER BY score DESC, id) AS o FROM near WHERE domain <> own_domain AND origin <> own_origin) WHERE o = 1),
    placed AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS place FROM once),
    turned AS (SELECT *, row_number() OVER (PARTITION BY q, domain ORDER BY place) AS round, min(place) OVER (PARTITION BY q, domain) AS first FROM placed),
    chosen AS (SELECT q, turn, id, domain, score, published_s, {_STANCE} AS stance FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round, first) AS turn FROM turned) WHERE turn <= 6),
    head AS (SELECT q, count(id) AS n, bool_or(stance = 'entailment') AS s, bool_or(stance = 'contradiction') AS c, bool_or(id IS NOT NULL AND published_s IS NULL) AS u FROM asked LEFT JOIN chosen USING (q) GROUP BY q)
    SELECT q, turn, id, domain, round(score, 5) AS score, stance, CASE WHEN s AND c THEN 'mixed' WHEN c THEN 'contradict' WHEN s THEN 'support' ELSE 'insufficient' END AS assessment,
      concat_ws('|', CASE WHEN n = 0 THEN '{inquiry.NO_EVIDENCE}' END, CASE WHEN u THEN '{inquiry.NO_TIME}' END, CASE WHEN n > 0 AND NOT s AND NOT c THEN '{inquiry.NEUTRAL}' END) AS warnings
    FROM head LEFT JOIN chosen USING (q)""",
)
def pl_10(spark, sf_dir):
    """Claims whose id is divisible by 100 against all claims with a vector, which is their article's; stances by words."""
    return _checked(spark, sf_dir)


@query("pl_10_with_passages")
def pl_10_passages(spark, sf_dir):
    """The same with the passage of each piece of evidence, searched in the whole body; the passage is judged."""
    return _checked(spark, sf_dir, domain.untimed_articles(spark, sf_dir).select("article_id", "content"))


def _checked(spark, sf_dir, articles=None):
    rows = domain.table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("v"))
    known = stage(domain.articles(spark, sf_dir).select("article_id", "content_hash", "collected_s"), "article-hashes")
    firsts = known.groupBy("content_hash").agg(F.min("article_id").alias("origin"))
    origin = known.select("article_id", "content_hash", "collected_s").join(firsts, "content_hash").drop("content_hash")
    base = rows.join(domain.claims(spark, sf_dir).drop("collected_s"), "article_id").join(origin, "article_id")
    base = base.select(F.col("claim_id").alias("id"), "v", "domain", "origin", "published_s", "collected_s", "extracted_s", F.col("claim_text").alias("text"), "article_id", F.col("article_id").alias("vec"))
    base = stage(base, "claims-with-vectors")
    asked = base.where("id % 100 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"), F.col("domain").alias("own_domain"), F.col("origin").alias("own_origin"), F.col("text").alias("q_text"))
    judge = verdicts.stance_by_words(F.col("q_text"), F.col("passage"))
    found = inquiry.check_claims(asked, base, None, catalog._now(spark, sf_dir), least=0.1, judge=judge, articles=articles)
    return found.withColumn("warnings", F.array_join("warnings", "|"))


_SAID = f"SELECT article_id, array_to_string(regexp_extract_all(lower(content), '{catalog._TOKEN}'), ' ') AS said FROM articles"


@query(
    "pl_7_typed_edges",
    f"""{catalog._CAND}, said AS ({_SAID}),
    r AS (SELECT child, parent, score, x.said <> y.said AS differs, row_number() OVER (PARTITION BY child ORDER BY score DESC, parent) AS place FROM cand JOIN said x ON x.article_id = child JOIN said y ON y.article_id = parent),
    f AS (SELECT *, min(CASE WHEN differs AND score >= 0.3 THEN place END) OVER (PARTITION BY child) AS first FROM r WHERE place <= 50),
    named AS (SELECT * FROM (SELECT child, parent, score, CASE WHEN place = first THEN 'EVOLVED_FROM' WHEN score >= 0.2 THEN 'SIMILAR_TO' END AS kind FROM f) WHERE kind IS NOT NULL),
    texts AS (SELECT child, parent, p.content AS a, c.content AS b FROM named JOIN articles p ON p.article_id = parent JOIN articles c ON c.article_id = child WHERE kind = 'EVOLVED_FROM'),
    {catalog.change_sql("texts", "child, parent")}
    SELECT child, parent, kind, round(score, 4) AS score, types FROM named LEFT JOIN changed USING (child, parent)""",
)
def pl_7(spark, sf_dir):
    """Edges among earlier articles of a topic by whole texts, with the kinds of change of each child and its parent."""
    rows, found = catalog._candidates(spark, sf_dir, 50, 0.2)  # as in pl_7_mutation_edges
    texts = domain.articles(spark, sf_dir).select(F.col("article_id").alias("id"), F.col("content").alias("text"))
    return inquiry.typed_mutations(found, texts.join(rows.select("id"), "id", "left_semi"), 0.3, 0.2)


_SIGNALS = {"corroboration": "corroboration AS v FROM corr", "contradiction": "contradiction FROM corr", "track_record": "signal FROM track", "entity_grounding": "signal FROM entity", "language": "signal FROM lang"}
_SIG = " UNION ALL ".join(f"SELECT claim_id, {k} AS o, '{name}' AS name, {lex.WEIGHTS[name]}::DOUBLE AS w, {rest}" for k, (name, rest) in enumerate(_SIGNALS.items()))


@query(
    "pl_13_strongest_factors",
    f"""{catalog._ENT}{catalog._EVID}{catalog._PRIORS}, lang AS ({catalog._language_sql()}), sig AS ({_SIG}),
    strong AS (SELECT *, round(abs(w * ln(h / (1 - h))), 9) AS s FROM (SELECT *, least(0.99::DOUBLE, greatest(0.01::DOUBLE, v)) AS h FROM sig)),
    placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY s DESC, o) AS INTEGER) AS place FROM strong)
    SELECT claim_id, place, name, CASE WHEN v >= 0.5 THEN 'raises' ELSE 'lowers' END AS direction, round(v, 6) AS value FROM placed WHERE place <= 2""",
)
def pl_13(spark, sf_dir):
    """The two signals that move each claim's score most."""
    claims = catalog.staged_claims(spark, sf_dir, *catalog.CLAIM_FACTS, "claim_text")
    evidence = catalog._evidence(spark, sf_dir, claims)
    backed = verdicts.corroboration(claims, evidence)
    return verdicts.strongest_factors(verdicts.signals(claims, evidence, catalog._priors(spark, sf_dir, claims), backed))


@query("snk_2_predictions_file", r"""SELECT page_id, nullif(regexp_replace(url, '^([=+\-@\t\r])', '''\1'), '') AS url, nullif(regexp_replace(html, '^([=+\-@\t\r])', '''\1'), '') AS html FROM pages""")
def snk_2(spark, sf_dir):
    """Pages through CSV files with safe cells and back."""
    return exports.write_predictions(domain.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
