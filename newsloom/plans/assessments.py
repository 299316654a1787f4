"""Queries of reports, weak labels, queues, snapshots and guards over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import lexicons as lex
from newsloom.functions import text as tx
from newsloom.functions.spans import ENTITY_KINDS
from newsloom.operators import datasets, evaluation, features, graph, modelling, ranking, records, vectors, verdicts
from newsloom.plans import catalog
from newsloom.plans.catalog import query
from newsloom.sources import domain

_BUCKET = "CASE WHEN sim_score >= 0.95 THEN 'b95' WHEN sim_score >= 0.85 THEN 'b85' WHEN sim_score >= 0.75 THEN 'b75' WHEN sim_score >= 0.6 THEN 'b60' WHEN sim_score >= 0.4 THEN 'b40' ELSE 'b00' END"
_SUMS = "count(*) AS pairs, sum(gold)::BIGINT AS positives, round(avg(sim_score), 6) AS mean_score"
_PEOPLE = "people AS (SELECT pair_id, count(DISTINCT annotator) AS voters, count(DISTINCT label) AS labels, min(label) AS label FROM votes WHERE origin = 'HUMAN' GROUP BY pair_id)"


@query(
    "ev_13_whole_report",
    f"""SELECT 'overall' AS part, 'all' AS name, {_SUMS} FROM eval_pairs UNION ALL SELECT 'origin', origin, {_SUMS} FROM eval_pairs JOIN (SELECT DISTINCT pair_id, origin FROM votes) USING (pair_id) GROUP BY origin
    UNION ALL SELECT 'bucket', {_BUCKET}, {_SUMS} FROM eval_pairs GROUP BY 2""",
)
def ev_13(spark, sf_dir):
    return evaluation.report(domain.eval_pairs(spark, sf_dir), domain.votes(spark, sf_dir), tx.similarity_bucket(F.col("sim_score")))


@query(
    "ev_14_agreement",
    f""", {_PEOPLE} SELECT split, count(*) AS pairs, count(v.pair_id) AS labelled, count(*) FILTER (WHERE voters >= 2) AS several, count(*) FILTER (WHERE voters >= 2 AND labels = 1) AS agreed, count(*) FILTER (WHERE voters >= 2 AND labels > 1) AS disagreed,
    round(count(*) FILTER (WHERE voters >= 2 AND labels = 1) / nullif(count(*) FILTER (WHERE voters >= 2), 0)::DOUBLE, 6) AS agreement FROM eval_pairs LEFT JOIN (SELECT DISTINCT pair_id FROM votes) v USING (pair_id) LEFT JOIN people USING (pair_id) GROUP BY split""",
)
def ev_14(spark, sf_dir):
    return evaluation.progress(domain.eval_pairs(spark, sf_dir), domain.votes(spark, sf_dir))


@query(
    "ev_23_pairs_by_cosine",
    f""", p AS (SELECT {catalog._COS.format('x.embedding', 'y.embedding')} >= 0.5 AS called, x.label = y.label AS gold FROM article_edges JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b WHERE x.label IS NOT NULL AND y.label IS NOT NULL),
    c AS (SELECT count(*) FILTER (WHERE called AND gold) AS tp, count(*) FILTER (WHERE called AND NOT gold) AS fp, count(*) FILTER (WHERE NOT called AND gold) AS fn, count(*) FILTER (WHERE gold) AS same, count(*) FILTER (WHERE NOT gold) AS other FROM p)
    SELECT *, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall FROM c""",
)
def ev_23(spark, sf_dir):
    """Article edges called related from cosine 0.5 on, against whether the vectors' labels agree."""
    rows = domain.table(spark, sf_dir, "embeddings").where("label is not null and embedding is not null").select("vec_id", "embedding", "label")
    pairs = domain.article_edges(spark, sf_dir).join(rows.toDF("a", "x", "la"), "a").join(rows.toDF("b", "y", "lb"), "b")
    pairs = pairs.select((vectors.cosine(F.col("x"), F.col("y")) >= 0.5).alias("called"), (F.col("la") == F.col("lb")).alias("gold"))
    called, gold = F.col("called"), F.col("gold")
    counts = pairs.agg(F.count_if(called & gold).alias("tp"), F.count_if(called & ~gold).alias("fp"), F.count_if(~called & gold).alias("fn"), F.count_if(gold).alias("same"), F.count_if(~gold).alias("other"))
    share = lambda n: F.round(F.when(F.col("tp") + F.col(n) > 0, F.col("tp") / (F.col("tp") + F.col(n))), 6)
    return counts.withColumns({"precision": share("fp"), "recall": share("fn")})


@query(
    "ev_25_weak_labels",
    rf""", lp AS (SELECT r.from_id, r.to_id, a.claim_text AS ta, b.claim_text AS tb, {catalog._SET.format("a.claim_text")} AS x, {catalog._SET.format("b.claim_text")} AS y FROM relations r JOIN claims a ON a.claim_id = r.from_id JOIN claims b ON b.claim_id = r.to_id),
    word AS (SELECT from_id, to_id, 0 AS side, ' ' || unnest(list_filter(string_split_regex(lower(ta), '[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+'), lambda x: x <> '')) || ' ' AS t FROM lp
      UNION ALL SELECT from_id, to_id, 1, ' ' || unnest(list_filter(string_split_regex(lower(tb), '[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+'), lambda x: x <> '')) || ' ' FROM lp),
    g AS (SELECT from_id, to_id, side, substr(t, i, n) AS term FROM word, (VALUES (3), (4), (5)) size(n), LATERAL (SELECT unnest(range(1, length(t) - n + 2)) AS i)),
    tc AS (SELECT from_id, to_id, term, count(*) FILTER (WHERE side = 0) AS x, count(*) FILTER (WHERE side = 1) AS y FROM g GROUP BY ALL),
    w AS (SELECT from_id, to_id, CASE WHEN x > 0 THEN (1 + ln(x)) * i ELSE 0.0 END AS u, CASE WHEN y > 0 THEN (1 + ln(y)) * i ELSE 0.0 END AS v FROM (SELECT *, CASE WHEN x > 0 AND y > 0 THEN 1.0::DOUBLE ELSE ln(1.5::DOUBLE) + 1 END AS i FROM tc)),
    cs AS (SELECT from_id, to_id, CASE WHEN sum(u * u) > 0 AND sum(v * v) > 0 THEN sum(u * v) / sqrt(sum(u * u) * sum(v * v)) ELSE 0.0 END AS cosine FROM w GROUP BY ALL),
    s AS (SELECT lp.from_id, lp.to_id, 0.4::DOUBLE * CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE ELSE 0.0 END + 0.6::DOUBLE * coalesce(cosine, 0.0) AS score FROM lp LEFT JOIN cs USING (from_id, to_id))
    SELECT from_id, to_id, round(score, 6) AS score, CASE WHEN score >= 0.4 THEN 'SAME_STORY' WHEN score >= 0.2 THEN 'EVOLVED' ELSE 'DISTINCT' END AS label FROM s""",
)
def ev_25(spark, sf_dir):
    """Relations labelled by .4 word Jaccard and .6 cosine of character n-grams fitted on the pair."""
    text = domain.claims(spark, sf_dir).select("claim_id", "claim_text")
    rows = domain.relations(spark, sf_dir).select("from_id", "to_id").join(text.toDF("from_id", "a"), "from_id").join(text.toDF("to_id", "b"), "to_id")
    words = tx.jaccard(tx.token_set(F.col("a")), tx.token_set(F.col("b")))
    score = 0.4 * words + 0.6 * features.pair_cosine()(tx.lower(F.col("a")), tx.lower(F.col("b")))
    label = F.when(F.col("score") >= 0.4, "SAME_STORY").when(F.col("score") >= 0.2, "EVOLVED").otherwise("DISTINCT")
    return rows.withColumn("score", score).select("from_id", "to_id", F.round("score", 6).alias("score"), label.alias("label"))


def _entity_set_sql(column: str) -> str:
    """Distinct lower-cased entities of a text's first 500 characters."""
    head = f"substr({column}, 1, 500)"
    kinds = ", ".join(f"regexp_extract_all({head}, '{p}')" for p in ENTITY_KINDS.values())
    tokens = f"list_filter(regexp_extract_all({head}, '{catalog._TOKEN}'), lambda t: regexp_matches(t, '^([A-Z][a-zA-Z]{{2,}}|[A-Z]{{2}})$') AND lower(t) NOT IN ({catalog._in(catalog._COMMON)}))"
    return f"list_distinct(list_filter(list_transform(flatten([{kinds}, {tokens}]), lambda t: lower(t)), lambda t: length(t) > 1))"


@query(
    "ev_25_entity_labels",
    f""", two AS (SELECT r.from_id, r.to_id, {_entity_set_sql("a.claim_text")} AS x, {_entity_set_sql("b.claim_text")} AS y FROM relations r JOIN claims a ON a.claim_id = r.from_id JOIN claims b ON b.claim_id = r.to_id),
    part AS (SELECT *, coalesce(list_sum(list_transform(x, lambda p: len(list_filter(y, lambda r: r <> p AND (contains(r, p) OR contains(p, r)))))), 0) AS partial FROM two),
    s AS (SELECT from_id, to_id, CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE + 0.1::DOUBLE * least(partial, 3) END AS score FROM part)
    SELECT from_id, to_id, round(score, 6) AS score, CASE WHEN score >= 0.5 THEN 'SAME_STORY' WHEN score >= 0.3 THEN 'EVOLVED' ELSE 'DISTINCT' END AS label FROM s""",
)
def ev_25_entities(spark, sf_dir):
    """Relations labelled by shared entities, whole and in part; a side without entities makes them distinct."""
    text = domain.claims(spark, sf_dir).select("claim_id", "claim_text")
    rows = domain.relations(spark, sf_dir).select("from_id", "to_id").join(text.toDF("from_id", "a"), "from_id").join(text.toDF("to_id", "b"), "to_id")
    rows = rows.select("from_id", "to_id", features.entity_set(F.col("a")).alias("x"), features.entity_set(F.col("b")).alias("y"))
    score = features.entity_overlap(F.col("x"), F.col("y"))
    label = F.when(F.col("score") >= 0.5, "SAME_STORY").when(F.col("score") >= 0.3, "EVOLVED").otherwise("DISTINCT")
    return rows.withColumn("score", score).select("from_id", "to_id", F.round("score", 6).alias("score"), label.alias("label"))


_TYPES = "CASE WHEN voted_s % 7 = 0 THEN NULL WHEN voted_s % 11 = 0 THEN {0}'FRAMING_SHIFT'{1} WHEN annotator = 'user:2' THEN {0}'WORDING_DRIFT', 'NUMERIC_DRIFT', 'WORDING_DRIFT'{1} ELSE {0}'NUMERIC_DRIFT', 'WORDING_DRIFT'{1} END"


_MARKED = f""", typed AS (SELECT pair_id, annotator, label, array_to_string(list_sort(list_distinct({_TYPES.format("[", "]")})), ',') AS types FROM votes WHERE origin = 'HUMAN'),
    people AS (SELECT pair_id, count(DISTINCT annotator) AS voters, count(DISTINCT label) AS labels, min(label) AS label, count(*) AS n, count(types) AS known, count(DISTINCT types) AS kinds, min(types) AS types FROM typed GROUP BY pair_id),
    judged AS (SELECT *, CASE WHEN labels > 1 THEN 'disagreement' WHEN voters >= 2 THEN 'agreed' ELSE 'needs_human_votes' END AS status FROM people),
    marked AS (SELECT *, CASE WHEN status <> 'agreed' OR known = 0 THEN 'not_annotated' WHEN kinds > 1 THEN 'disagreement' WHEN known < n THEN 'incomplete' ELSE 'agreed' END AS mutation_status FROM judged)"""


@query(
    "ev_11_consensus_on_types",
    f"""{_MARKED}
    SELECT pair_id, voters, status, CASE WHEN status = 'agreed' THEN label END AS label, mutation_status, CASE WHEN mutation_status = 'agreed' THEN types END AS mutation_types FROM marked""",
)
def ev_11_types(spark, sf_dir):
    """Kinds of change follow from a vote's time and voter, for want of a column."""
    return evaluation.typed_consensus(domain.votes(spark, sf_dir).withColumn("mutation_types", F.expr(_TYPES.format("array(", ")"))))


@query(
    "ev_26_records_with_exclusions",
    f""", {_PEOPLE}, n AS (SELECT pair_id, count(*) AS n_votes FROM votes GROUP BY pair_id), r AS (SELECT p.pair_id, p.event_group, p.split, p.gold, coalesce(n_votes, 0) AS n_votes, CASE WHEN voters >= 2 AND labels = 1 THEN label END AS consensus FROM eval_pairs p LEFT JOIN n USING (pair_id) LEFT JOIN people USING (pair_id))
    SELECT *, CASE WHEN gold IS NULL THEN 'no gold label' WHEN n_votes = 0 THEN 'no votes' WHEN consensus IS NULL THEN 'no consensus' END AS excluded FROM r""",
)
def ev_26(spark, sf_dir):
    return evaluation.export_records(domain.eval_pairs(spark, sf_dir), domain.votes(spark, sf_dir)).select("pair_id", "event_group", "split", "gold", "n_votes", "consensus", "excluded")


_PAIR_RECORDS = f"""{_MARKED},
    chosen AS (SELECT pair_id, event_group, CASE WHEN event_group % 13 <> 0 THEN split END AS split, sim_score, CASE WHEN gold = 1 THEN 'SAME_STORY' ELSE 'DISTINCT' END AS gold_label,
      pair_id * 8 AS claim_a_id, pair_id * 8 + CASE WHEN pair_id % 29 = 0 THEN 0 ELSE 1 END AS claim_b_id FROM eval_pairs),
    listed AS (SELECT pair_id, string_agg(concat_ws(':', origin, annotator, label, voted_s), ';' ORDER BY origin, annotator) AS votes, count(*) FILTER (WHERE origin = 'HUMAN') AS n_human, count(*) AS n_votes FROM votes GROUP BY pair_id),
    said AS (SELECT o.*, a.claim_text AS text_a, b.claim_text AS text_b, {catalog._SET.format("a.claim_text")} AS wa, {catalog._SET.format("b.claim_text")} AS wb,
      {catalog._ENTITY_SET.format("coalesce(a.claim_text, '')")} AS ea, {catalog._ENTITY_SET.format("coalesce(b.claim_text, '')")} AS eb
      FROM chosen o LEFT JOIN claims a ON a.claim_id = claim_a_id LEFT JOIN claims b ON b.claim_id = claim_b_id),
    filled AS (SELECT *, coalesce(status, 'needs_human_votes') AS stated, coalesce(mutation_status, 'not_annotated') AS on_types, CASE WHEN status = 'agreed' THEN label END AS consensus,
      coalesce(votes, '') AS listed_votes, coalesce(n_human, 0) AS humans, coalesce(n_votes, 0) AS all_votes,
      CASE WHEN text_a IS NOT NULL AND text_b IS NOT NULL THEN CASE WHEN len(wa) + len(wb) > 0 THEN len(list_intersect(wa, wb)) / (len(wa) + len(wb) - len(list_intersect(wa, wb)))::DOUBLE ELSE 0.0 END END AS lexical,
      CASE WHEN len(ea) + len(eb) > 0 THEN len(list_intersect(ea, eb)) / (len(ea) + len(eb) - len(list_intersect(ea, eb)))::DOUBLE END AS entity
      FROM said LEFT JOIN listed USING (pair_id) LEFT JOIN marked USING (pair_id)),
    records AS (SELECT pair_id, event_group, split, sim_score, gold_label, claim_a_id, claim_b_id, text_a, text_b, listed_votes AS votes, humans AS n_human, all_votes AS n_votes, stated AS status, consensus, on_types AS mutation_status,
      CASE WHEN mutation_status = 'agreed' THEN types END AS mutation_types, round(lexical, 6) AS lexical_jaccard, round(entity, 6) AS entity_jaccard,
      CASE WHEN stated <> 'agreed' THEN stated WHEN split IS NULL THEN 'unassigned_event_or_split' END AS excluded FROM filled)"""


def _pair_records(spark, sf_dir):
    """Pairs of an article's first two claims (of one claim, where the id is divisible by 29); some groups are not yet in a split."""
    pairs = domain.eval_pairs(spark, sf_dir).select(
        "pair_id", "event_group", F.when(F.col("event_group") % 13 != 0, F.col("split")).alias("split"), "sim_score",
        F.when(F.col("gold") == 1, "SAME_STORY").otherwise("DISTINCT").alias("gold_label"),
        (F.col("pair_id") * 8).alias("claim_a_id"), (F.col("pair_id") * 8 + F.when(F.col("pair_id") % 29 == 0, 0).otherwise(1)).alias("claim_b_id"),
    )
    text = domain.claims(spark, sf_dir).select("claim_id", "claim_text")
    pairs = pairs.join(text.toDF("claim_a_id", "text_a"), "claim_a_id", "left").join(text.toDF("claim_b_id", "text_b"), "claim_b_id", "left")
    return records.pair_records(pairs, domain.votes(spark, sf_dir).withColumn("mutation_types", F.expr(_TYPES.format("array(", ")"))))


@query("ev_26_whole_records", _PAIR_RECORDS + " SELECT pair_id, event_group, split, gold_label, votes, n_human, n_votes, status, consensus, mutation_status, mutation_types, lexical_jaccard, entity_jaccard, excluded FROM records")
def ev_26_whole(spark, sf_dir):
    """Each pair with features, all votes, the people's consensus on label and kinds of change, and why it is left out."""
    votes = F.array_join(F.transform("votes", lambda v: F.concat_ws(":", v["origin"], v["annotator"], v["label"], v["voted_s"].cast("string"))), ";")
    rows = _pair_records(spark, sf_dir).withColumns({"votes": votes, "lexical_jaccard": F.round("lexical_jaccard", 6), "entity_jaccard": F.round("entity_jaccard", 6)})
    return rows.select("pair_id", "event_group", "split", "gold_label", "votes", "n_human", "n_votes", "status", "consensus", "mutation_status", "mutation_types", "lexical_jaccard", "entity_jaccard", "excluded")


@query("ev_26_exclusions", _PAIR_RECORDS + " SELECT coalesce(excluded, 'selected') AS reason, count(*) AS records FROM records GROUP BY ALL")
def ev_26_exclusions(spark, sf_dir):
    return records.exclusions(_pair_records(spark, sf_dir))


@query(
    "ev_15_invalid_records",
    _PAIR_RECORDS + """ SELECT * FROM (SELECT pair_id, concat_ws(',', CASE WHEN split IS NULL THEN 'event_or_split' END, CASE WHEN claim_a_id = claim_b_id THEN 'self_pair' END,
      CASE WHEN text_a IS NULL OR text_b IS NULL THEN 'text' END, CASE WHEN n_human = 0 THEN 'human_votes' END, CASE WHEN status <> 'agreed' OR consensus <> gold_label THEN 'consensus' END) AS reasons FROM records) WHERE reasons <> ''""",
)
def ev_15_whole(spark, sf_dir):
    """Records that break any rule of a dataset's records; on the given tables five of the nine are broken."""
    return records.invalid_records(_pair_records(spark, sf_dir)).select("pair_id", "reasons")


@query(
    "win_9_uncertain_first",
    """SELECT annotator, pair_id FROM (SELECT annotator, pair_id, row_number() OVER (PARTITION BY annotator ORDER BY abs(sim_score - 0.6), pair_id) AS r FROM (SELECT DISTINCT annotator FROM votes) u, (SELECT * FROM eval_pairs WHERE split = 'train') p
    WHERE NOT EXISTS (SELECT 1 FROM votes v WHERE v.annotator = u.annotator AND v.pair_id = p.pair_id)) WHERE r = 1""",
)
def win_9(spark, sf_dir):
    return ranking.next_pair(domain.eval_pairs(spark, sf_dir), domain.votes(spark, sf_dir), uncertain_first=True)


@query(
    "agg_18_whole_snapshot",
    """SELECT 'articles' AS name, count(*) AS n FROM articles UNION ALL SELECT 'claims', count(*) FROM claims UNION ALL SELECT 'embedded', count(embedding) FROM embeddings UNION ALL SELECT 'topics', count(DISTINCT topic_id) FROM claims WHERE topic_id >= 0
    UNION ALL SELECT 'sources', count(DISTINCT domain) FROM articles UNION ALL SELECT kind, count(*) FROM relations GROUP BY kind UNION ALL SELECT 'first_s', min(published_s) FROM articles UNION ALL SELECT 'last_s', max(published_s) FROM articles
    UNION ALL SELECT 'runs', count(*) FROM ev WHERE event_type = 'signup'
    UNION ALL SELECT 'longest_chain', coalesce(max(n), 0) FROM (WITH RECURSIVE w AS (SELECT to_id AS at, 1 AS n FROM relations WHERE kind = 'EVOLVED_FROM' UNION ALL SELECT r.to_id, n + 1 FROM w JOIN relations r ON r.from_id = w.at AND r.kind = 'EVOLVED_FROM') SELECT max(n) AS n FROM w)""",
)
def agg_18(spark, sf_dir):
    """Totals by name, with the longest chain; sign-ups stand for runs."""
    articles, claims = domain.articles(spark, sf_dir), domain.claims(spark, sf_dir)
    one = lambda df, name, value: df.agg(value.alias("n")).select(F.lit(name).alias("name"), "n")
    parts = [
        one(articles, "articles", F.count("*")),
        one(claims, "claims", F.count("*")),
        one(domain.table(spark, sf_dir, "embeddings"), "embedded", F.count("embedding")),
        one(claims.where("topic_id >= 0"), "topics", F.count_distinct("topic_id")),
        one(articles, "sources", F.count_distinct("domain")),
        domain.relations(spark, sf_dir).groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")),
        one(articles, "first_s", F.min("published_s")),
        one(articles, "last_s", F.max("published_s")),
        one(domain.events(spark, sf_dir).where("event_type = 'signup'"), "runs", F.count("*")),
        graph.longest_chain(domain.relations(spark, sf_dir).where("kind = 'EVOLVED_FROM'")).select(F.lit("longest_chain").alias("name"), F.col("longest_chain").cast("long").alias("n")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "pl_2_claims_with_entities",
    catalog._ENT + " SELECT c.claim_id, c.article_id, c.confidence, count(e.e) AS entities, bool_or(v.vec_id IS NOT NULL) AS has_vector FROM claims c LEFT JOIN ent e USING (claim_id) LEFT JOIN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL) v ON v.vec_id = c.article_id WHERE c.confidence >= 0.5 GROUP BY ALL",
)
def pl_2(spark, sf_dir):
    """Claims worth checking, with how many entity rows each has and whether its article has a vector."""
    claims = domain.claims(spark, sf_dir).where("confidence >= 0.5").select("claim_id", "article_id", "claim_text", "confidence")
    entities = verdicts.entity_rows(claims).groupBy("claim_id").agg(F.count("*").alias("entities"))
    vector = domain.table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("article_id"), F.lit(True).alias("has_vector"))
    rows = claims.join(entities, "claim_id", "left").join(vector, "article_id", "left")
    return rows.select("claim_id", "article_id", "confidence", F.coalesce("entities", F.lit(0)).cast("long").alias("entities"), F.coalesce("has_vector", F.lit(False)).alias("has_vector"))


@query(
    "pl_4_cycle_guards",
    """, s AS (SELECT (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS embedded, (SELECT max(at_s) FROM ev WHERE event_type = 'signup') AS last_run),
    f AS (SELECT count(*) AS fresh FROM claims WHERE extracted_s > coalesce((SELECT last_run FROM s), 0))
    SELECT forced, new_version, CASE WHEN embedded < 30 THEN 'corpus_too_small' WHEN fresh < 10 AND NOT forced AND NOT new_version THEN 'nothing_new' ELSE 'run' END AS status, embedded, fresh
    FROM s, f, (VALUES (FALSE, FALSE), (TRUE, FALSE), (FALSE, TRUE)) o(forced, new_version)""",
)
def pl_4(spark, sf_dir):
    """The guard of a cycle as it stands, forced, and after a change of the algorithm; sign-ups stand for earlier runs."""
    embedded = domain.table(spark, sf_dir, "embeddings").where("embedding is not null").count()
    last = domain.events(spark, sf_dir).where("event_type = 'signup'").agg(F.max("at_s")).first()[0]
    fresh = domain.claims(spark, sf_dir).where(F.col("extracted_s") > (last or 0)).agg(F.count("*").alias("fresh"))
    options = F.explode(F.array(*[F.struct(F.lit(f).alias("forced"), F.lit(v).alias("new_version")) for f, v in ((False, False), (True, False), (False, True))]))
    rows = fresh.select("fresh", options.alias("o")).select("o.*", F.lit(embedded).cast("long").alias("embedded"), "fresh")
    idle = (F.col("fresh") < 10) & ~F.col("forced") & ~F.col("new_version")
    return rows.withColumn("status", F.when(F.col("embedded") < 30, "corpus_too_small").when(idle, "nothing_new").otherwise("run"))


@query(
    "gr_11_claim_graph_with_fallback",
    f""", top AS (SELECT claim_id, vec_id, embedding FROM claims JOIN embeddings ON vec_id = article_id AND embedding IS NOT NULL WHERE verdict IS NOT NULL ORDER BY confidence DESC NULLS LAST, claim_id LIMIT 400),
    persisted AS (SELECT from_id, to_id, kind, 'persisted' AS source FROM relations WHERE from_id IN (SELECT claim_id FROM top) AND to_id IN (SELECT claim_id FROM top)),
    near AS (SELECT x.claim_id AS q, y.claim_id AS id, row_number() OVER (PARTITION BY x.claim_id ORDER BY {catalog._COS.format('x.embedding', 'y.embedding')} DESC, y.claim_id) AS r FROM top x JOIN top y ON x.claim_id <> y.claim_id)
    SELECT * FROM persisted UNION ALL SELECT DISTINCT least(q, id), greatest(q, id), 'SIMILAR_TO', 'nearest' FROM near WHERE r <= 4 AND NOT EXISTS (SELECT 1 FROM persisted)""",
)
def gr_11(spark, sf_dir):
    """The most confident scored claims whose article has a vector; edges between them, or nearest neighbours if none."""
    rows = domain.table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("v"))
    claims = catalog.staged_claims(spark, sf_dir, "claim_id", "article_id", "confidence", "verdict", "extracted_s")
    scored = claims.where("verdict is not null").join(rows, "article_id")
    return verdicts.claim_graph(scored.select("claim_id", "confidence", "v"), domain.relations(spark, sf_dir, claims), 400, 4)


_BUCKETS = [name for _, name in lex.BUCKETS]


@query("win_10_pairs_by_bucket")
def win_10(spark, sf_dir):
    """Up to 50 pairs a bucket, two a document, pairs of two outlets first."""
    outlet = domain.articles(spark, sf_dir).select("article_id", "domain")
    rows = domain.article_edges(spark, sf_dir).join(outlet.toDF("a", "of_a"), "a").join(outlet.toDF("b", "of_b"), "b")
    rows = rows.select("a", "b", "score", tx.similarity_bucket(F.col("score")).alias("bucket"), F.col("of_a").eqNullSafe(F.col("of_b")).alias("same_outlet"))
    return ranking.bucketed_pairs(rows, _BUCKETS, 50)


@query("ev_24_new_sample")
def ev_24(spark, sf_dir):
    """New pairs of claims at one place of similar articles; relations exist already, frozen where the child's article is in test."""
    known = catalog.staged_claims(spark, sf_dir, "claim_id", "article_id", "domain", "extracted_s")
    claims = known.select(F.col("claim_id").alias("id"), "article_id", "domain", (F.col("claim_id") % 8).alias("pos"))
    left, right = (claims.select(F.col("id").alias(x), F.col("article_id").alias(f"at_{x}"), F.col("domain").alias(f"of_{x}"), "pos") for x in ("a", "b"))
    edges = domain.article_edges(spark, sf_dir).toDF("at_a", "at_b", "score")
    rows = edges.join(left, "at_a").join(right, ["at_b", "pos"])
    rows = rows.select("a", "b", "score", tx.similarity_bucket(F.col("score")).alias("bucket"), F.col("of_a").eqNullSafe(F.col("of_b")).alias("same_outlet"))
    split = domain.eval_pairs(spark, sf_dir).select(F.col("pair_id").alias("article_id"), (F.col("split") == "test").alias("frozen"))
    known = domain.relations(spark, sf_dir, known).select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).distinct()
    known = known.join(claims.select(F.col("id").alias("a"), "article_id"), "a").join(split, "article_id", "left")
    known = catalog.stage(known.select("a", "b", F.coalesce("frozen", F.lit(False)).alias("frozen")), "known-pairs")
    return ranking.new_sample(rows, known, claims.select("id", "article_id"), _BUCKETS, 50)


@query("pl_3_named_topics")
def pl_3(spark, sf_dir):
    text = domain.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = domain.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).join(text, "id", "left")
    return modelling.named_topics(rows, 8).withColumn("keywords", F.array_join("keywords", ","))


@query("ev_18_ablations")
def ev_18(spark, sf_dir):
    size = domain.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.log(F.col("n_chars") + 1).alias("size"))
    return modelling.logistic_ablations(domain.eval_pairs(spark, sf_dir).join(size, "pair_id", "left"), ["sim_score", "size"])


# ---------------------------------------------------------------- checks of records

_RECORDS = """
, record0 AS (SELECT pair_id, CAST(event_group AS VARCHAR) AS event_id, split, gold, CASE WHEN pair_id % 97 = 0 THEN 'v2' ELSE 'v1' END AS dataset_version, pair_id * 8 AS claim_a_id, (pair_id + 2 * (pair_id % 2)) * 8 + 1 AS claim_b_id, pair_id AS article_a_id, pair_id + 2 * (pair_id % 2) AS article_b_id FROM eval_pairs),
record1 AS (SELECT * FROM record0 UNION ALL SELECT pair_id + 10000000, event_id, split, gold, dataset_version, claim_b_id, claim_a_id, article_b_id, article_a_id FROM record0 WHERE pair_id % 50 = 0),
record AS (SELECT r.*, x.content_hash AS hash_a, y.content_hash AS hash_b FROM record1 r LEFT JOIN articles x ON x.article_id = article_a_id LEFT JOIN articles y ON y.article_id = article_b_id)"""


def _components_sql(source: str, name: str) -> str:
    """name: (pair_id, component) of the records in a source."""
    return f"""{name}_token AS (SELECT pair_id, unnest([CASE WHEN event_id <> 'unassigned' THEN 'event:' || event_id END, 'claim:' || claim_a_id, 'claim:' || claim_b_id, 'article:' || article_a_id, 'article:' || article_b_id, 'hash:' || hash_a, 'hash:' || hash_b]) AS t FROM {source}),
    {name}_star AS (SELECT pair_id AS a, min(pair_id) OVER (PARTITION BY t) AS b FROM {name}_token WHERE t IS NOT NULL), {name}_link AS (SELECT a, b FROM {name}_star UNION SELECT b, a FROM {name}_star),
    {name} AS (WITH RECURSIVE w AS (SELECT a AS node, a AS seen FROM {name}_link UNION SELECT w.node, l.b FROM w JOIN {name}_link l ON l.a = w.seen) SELECT node AS pair_id, min(seen) AS component FROM w GROUP BY node)"""


def _records(spark, sf_dir):
    """Evaluation pairs as records: two articles' claims each; every fiftieth comes again the other way round."""
    pairs = domain.eval_pairs(spark, sf_dir)
    other = F.col("pair_id") + 2 * (F.col("pair_id") % 2)
    rows = pairs.select(
        "pair_id", F.col("event_group").cast("string").alias("event_id"), "split", "gold", F.when(F.col("pair_id") % 97 == 0, "v2").otherwise("v1").alias("dataset_version"),
        (F.col("pair_id") * 8).alias("claim_a_id"), (other * 8 + 1).alias("claim_b_id"), F.col("pair_id").alias("article_a_id"), other.alias("article_b_id"),
    )
    swap = {"claim_a_id": "claim_b_id", "claim_b_id": "claim_a_id", "article_a_id": "article_b_id", "article_b_id": "article_a_id"}
    again = rows.where("pair_id % 50 = 0").select((F.col("pair_id") + 10_000_000).alias("pair_id"), *[F.col(swap.get(c, c)).alias(c) for c in rows.columns[1:]])
    rows = rows.unionByName(again)
    hashes = domain.articles(spark, sf_dir).select("article_id", "content_hash")
    for side in datasets.SIDES:
        rows = rows.join(hashes.toDF(f"article_{side}_id", f"hash_{side}"), f"article_{side}_id", "left").withColumns({f"canonical_{side}_id": F.lit(None).cast("long"), f"text_key_{side}": F.lit(None).cast("string")})
    return rows


@query(
    "ev_16_dataset_problems",
    f"""{_RECORDS}, {_components_sql("record", "grouped")}, vote_id AS (SELECT pair_id % 3000 || annotator AS v FROM votes),
    named AS (SELECT * FROM record JOIN grouped USING (pair_id)),
    support AS (SELECT s.split, least(count(*) FILTER (gold = 1), count(*) FILTER (gold = 0), count(DISTINCT component)) AS n FROM (VALUES ('train'), ('dev'), ('test'), ('extra')) s(split) LEFT JOIN named n ON n.split = s.split GROUP BY s.split)
    SELECT 'same claims' AS problem, least(claim_a_id, claim_b_id) || ':' || greatest(claim_a_id, claim_b_id) AS subject, count(*) AS n FROM record GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'repeated pair', CAST(pair_id AS VARCHAR), count(*) FROM record GROUP BY pair_id HAVING count(*) > 1 UNION ALL SELECT 'repeated vote', v, count(*) FROM vote_id GROUP BY v HAVING count(*) > 1
    UNION ALL SELECT 'versions', 'dataset_version', count(DISTINCT dataset_version) FROM record HAVING count(DISTINCT dataset_version) > 1
    UNION ALL SELECT 'leakage', CAST(component AS VARCHAR), count(DISTINCT split) FROM named GROUP BY component HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'support', split, n FROM support WHERE n < 2""",
)
def ev_16_problems(spark, sf_dir):
    votes = domain.votes(spark, sf_dir).select(F.concat((F.col("pair_id") % 3000).cast("string"), "annotator").alias("vote_id"))
    return datasets.validate_dataset(_records(spark, sf_dir), votes, ["train", "dev", "test", "extra"])


_CHANGED = "event_id % 4 = 0 AND pair_id % 7 <> 0 OR pair_id % 41 = 0"


@query(
    "ev_17_assignment_problems",
    f"""{_RECORDS}, rec AS (SELECT * REPLACE (CASE WHEN CAST(event_id AS BIGINT) % 4 = 0 THEN 'unassigned' ELSE split END AS split, CASE WHEN CAST(event_id AS BIGINT) % 4 = 0 THEN 'unassigned' ELSE event_id END AS event_id), event_id AS own_event FROM record),
    change AS (SELECT CASE WHEN pair_id % 43 = 0 THEN pair_id + 50000000 ELSE pair_id END AS pair_id, CASE WHEN pair_id % 41 = 0 THEN 'test' ELSE 'train' END AS new_split, own_event AS new_event FROM rec WHERE {_CHANGED.replace("event_id", "CAST(own_event AS BIGINT)")}
      UNION ALL SELECT pair_id, 'dev', own_event FROM rec WHERE pair_id % 47 = 0),
    twice AS (SELECT pair_id, count(*) AS n FROM change GROUP BY pair_id HAVING count(*) > 1), frozen AS (SELECT pair_id, count(*) AS n FROM change JOIN rec USING (pair_id) WHERE split <> 'unassigned' AND (new_split <> split OR new_event <> event_id) GROUP BY pair_id),
    made AS (SELECT * FROM change WHERE pair_id NOT IN (SELECT pair_id FROM twice UNION ALL SELECT pair_id FROM frozen)),
    moved AS (SELECT rec.* REPLACE (coalesce(new_split, split) AS split, coalesce(new_event, event_id) AS event_id) FROM rec LEFT JOIN made USING (pair_id)), {_components_sql("moved", "grouped")},
    sums AS (SELECT component, count(*) FILTER (split = 'unassigned' OR event_id = 'unassigned') AS open, count(DISTINCT split) AS splits, count(DISTINCT event_id) AS events FROM moved JOIN grouped USING (pair_id)
      WHERE component IN (SELECT component FROM grouped JOIN change USING (pair_id)) GROUP BY component)
    SELECT 'assigned twice' AS problem, CAST(pair_id AS VARCHAR) AS subject, n FROM twice UNION ALL SELECT 'unknown pair', CAST(pair_id AS VARCHAR), count(*) FROM change WHERE pair_id NOT IN (SELECT pair_id FROM rec) GROUP BY pair_id
    UNION ALL SELECT 'frozen', CAST(pair_id AS VARCHAR), n FROM frozen UNION ALL SELECT 'assigned in part', CAST(component AS VARCHAR), open FROM sums WHERE open > 0
    UNION ALL SELECT 'crosses', CAST(component AS VARCHAR), greatest(splits, events) FROM sums WHERE open = 0 AND (splits > 1 OR events > 1)""",
)
def ev_17_problems(spark, sf_dir):
    """A quarter of the events is not assigned yet; changes assign most of their pairs, some twice, unknown or frozen."""
    rows = _records(spark, sf_dir).withColumn("own", F.col("event_id"))
    free = F.col("own").cast("long") % 4 == 0
    rows = rows.withColumns({c: F.when(free, datasets.UNASSIGNED).otherwise(F.col(c)) for c in ("split", "event_id")})
    changed = rows.where(free & (F.col("pair_id") % 7 != 0) | (F.col("pair_id") % 41 == 0))
    unknown = F.when(F.col("pair_id") % 43 == 0, F.col("pair_id") + 50_000_000).otherwise(F.col("pair_id"))
    changes = changed.select(unknown.alias("pair_id"), F.when(F.col("pair_id") % 41 == 0, "test").otherwise("train").alias("split"), F.col("own").alias("event_id"))
    changes = changes.unionByName(rows.where("pair_id % 47 = 0").select("pair_id", F.lit("dev").alias("split"), F.col("own").alias("event_id")))
    return datasets.validate_assignments(rows.drop("own"), changes)
