"""Signals, pooled scores and evidence of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import lexicons as lex
from newsloom.functions import text as tx
from newsloom.functions.spans import SPARK_ENTITY_KINDS
from newsloom.operators import vectors
from newsloom.plans.staging import stage


def entity_rows(claims: DataFrame) -> DataFrame:
    """(claim_id, entity_text, entity_type): capitalised runs, money, percentages, years and other numbers in a claim."""
    def rows(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("claim_text", F.lit(pattern), F.lit(0)), lambda t: F.struct(t.alias("entity_text"), F.lit(kind).alias("entity_type")))

    found = [rows(kind, pattern) for kind, pattern in SPARK_ENTITY_KINDS.items()]
    return claims.select("claim_id", F.explode(F.concat(*found)).alias("e")).select("claim_id", "e.entity_text", "e.entity_type")


def entity_signal(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """Per claim: .30 without entities, .45 without strong ones, else .55 and .15 for each, 1 at most."""
    counts = entities.groupBy("claim_id").agg(F.count("*").alias("total"), F.count_if(F.col("entity_type").isin(*lex.STRONG_ENTITY_TYPES)).alias("strong"))
    rows = claims.select("claim_id").join(counts, "claim_id", "left")
    value = F.when(F.coalesce("total", F.lit(0)) == 0, 0.30).when(F.col("strong") == 0, 0.45).otherwise(F.least(F.lit(100), 55 + 15 * F.col("strong")) / 100.0)
    return rows.select("claim_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("strong", F.lit(0)).alias("strong"), value.alias("signal"))


def corroboration(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Corroboration and contradiction per claim from (claim_id, domain, syndication_group, stance) of other outlets.

    A syndication group counts once, with its first outlet; distinct outlets count, not rows.
    """
    other = evidence.join(claims.select("claim_id", F.col("domain").alias("own")), "claim_id").where("domain <> own")
    once = other.groupBy("claim_id", "syndication_group", "stance").agg(F.min("domain").alias("domain"))
    distinct = lambda stance: F.size(F.collect_set(F.when(F.col("stance") == stance, F.col("domain")))).cast("long")
    counts = once.groupBy("claim_id").agg(distinct("entailment").alias("support"), distinct("contradiction").alias("against"))
    rows = claims.select("claim_id").join(counts, "claim_id", "left").select("claim_id", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("against", F.lit(0)).alias("against"))
    backed = F.when(F.col("support") == 0, 0.30).otherwise(0.35 + 0.65 * (1 - F.exp(-F.col("support") / 1.5)))
    share = F.when(F.col("support") + F.col("against") > 0, F.col("against") / (F.col("support") + F.col("against"))).otherwise(F.lit(0.0))
    return rows.select("claim_id", "support", "against", F.round(backed, 3).alias("corroboration"), F.round(0.5 - 0.5 * share, 3).alias("contradiction"))


def track_record(claims: DataFrame, priors: DataFrame) -> DataFrame:
    """(s + 2) / (n + 4) of an outlet's validated counts, .5 without them."""
    joined = claims.select("claim_id", "domain").join(priors.select("domain", "supported", "checked"), "domain", "left")
    return joined.select("claim_id", F.round(F.coalesce((F.col("supported") + 2) / (F.col("checked") + 4), F.lit(0.5)), 6).alias("signal"))


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def pool(signals: DataFrame, by: tuple[str, ...] = ("claim_id",)) -> DataFrame:
    """Per claim: weighted mean of log odds as a probability between .02 and .98. signals: (claim_id, name, value)."""
    weight = F.create_map(*[F.lit(x) for kv in lex.WEIGHTS.items() for x in kv])[F.col("name")]
    held = _clamp(F.col("value"), 0.01, 0.99)
    rows = signals.select(*by, weight.alias("w"), F.log(held / (1 - held)).alias("odds"))
    mean = rows.groupBy(*by).agg((F.sum(F.col("w") * F.col("odds")) / F.sum("w")).alias("x"))
    return mean.select(*by, F.round(_clamp(1 / (1 + F.exp(-F.col("x"))), 0.02, 0.98), 4).alias("probability"))


def backing(backed: DataFrame) -> DataFrame:
    """(claim_id, name, value): a claim's corroboration and contradiction, both from one pass over `corroboration`'s rows."""
    pair = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("corroboration", "contradiction")])
    return backed.select("claim_id", F.explode(pair).alias("x")).select("claim_id", "x.name", "x.value")


def signals(claims: DataFrame, evidence: DataFrame, priors: DataFrame, backed: DataFrame) -> DataFrame:
    """(claim_id, name, value): the five signals of every claim; backed is their corroboration."""
    one = lambda df, name, value: df.select("claim_id", F.lit(name).alias("name"), F.col(value).alias("value"))
    language = claims.select("claim_id", tx.language_signal(F.col("claim_text")).alias("signal"))
    found = backing(backed).union(one(track_record(claims, priors), "track_record", "signal"))
    return found.union(one(entity_signal(claims, entity_rows(claims)), "entity_grounding", "signal")).union(one(language, "language", "signal"))


def score_claims(claims: DataFrame, evidence: DataFrame, priors: DataFrame) -> DataFrame:
    """claim_id, probability, band for every claim from its five signals."""
    backed = corroboration(claims, evidence)
    rows = pool(signals(claims, evidence, priors, backed)).join(backed, "claim_id")
    return rows.select("claim_id", "probability", tx.verdict_band(F.col("probability"), F.col("against") > 0, F.col("support") > 0).alias("band"))


def strongest_factors(signals: DataFrame, most: int = 2) -> DataFrame:
    """(claim_id, place, name, direction, value): the signals with the largest weighted log odds of each claim.

    Equal ones come in the order of the weights; from .5 on a signal raises the score, below it lowers it.
    """
    names = list(lex.WEIGHTS)
    weight = F.create_map(*[F.lit(x) for kv in lex.WEIGHTS.items() for x in kv])[F.col("name")]
    held = _clamp(F.col("value"), 0.01, 0.99)
    strength = F.round(F.abs(weight * F.log(held / (1 - held))), 9)
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
    rows = signals.groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct((-strength).alias("s"), order.alias("o"), "name", "value"))).alias("all"))  # one row for each signal
    top = rows.select("claim_id", F.posexplode(F.slice("all", 1, most)).alias("at", "x"))
    direction = F.when(F.col("x.value") >= 0.5, "raises").otherwise("lowers")
    return top.select("claim_id", (F.col("at") + 1).alias("place"), "x.name", direction.alias("direction"), F.round("x.value", 6).alias("value"))


def stance_by_words(claim: Column, passage: Column, least: float = 0.1) -> Column:
    """A stand-in where no stance model is at hand: neutral below `least` of shared words, else contradiction if words of
    polarity or numbers differ, else entailment."""
    near = tx.jaccard(tx.token_set(claim), tx.token_set(passage))
    differ = lambda f: F.array_sort(f(claim)) != F.array_sort(f(passage))
    against = differ(lambda c: tx.lexicon_tokens(c, "polarity")) | differ(tx.numeric_tokens)
    return F.when(near < least, "neutral").when(against, "contradiction").when(near.isNotNull(), "entailment").otherwise("neutral")


def assessment(stances: DataFrame) -> DataFrame:
    """Per claim: mixed, contradicting, supporting or insufficient, from (claim_id, stance)."""
    rows = stances.groupBy("claim_id").agg(F.bool_or(F.col("stance") == "entailment").alias("s"), F.bool_or(F.col("stance") == "contradiction").alias("c"))
    return rows.select("claim_id", F.when(F.col("s") & F.col("c"), "mixed").when(F.col("c"), "contradict").when(F.col("s"), "support").otherwise("insufficient").alias("assessment"))


def evidence_passage(claims: DataFrame, articles: DataFrame, least_length: int = 3) -> DataFrame:
    """Per claim the sentence of its article that shares most terms with the article's title (the first of equals)."""
    terms = F.filter(tx.token_set(F.col("title")), lambda t: F.length(t) >= least_length)
    named = claims.join(articles.select("article_id", terms.alias("terms")), "article_id")
    scored = named.withColumn("overlap", F.size(F.array_intersect("terms", tx.token_set(F.col("claim_text")))))
    best = scored.groupBy("article_id").agg(F.max(F.struct("overlap", (-F.col("claim_id")).alias("minus"))).alias("x"))
    return best.select("article_id", (-F.col("x.minus")).alias("claim_id"), F.col("x.overlap").cast("long").alias("overlap"))


#: A sentence with the white space before it: it ends at . ! or ? before white space, at a line end or at the end.
_SENTENCE = r"(?sdU)\s*\S.*?(?:[.!?](?=\s|$)|\n|$)"


def body_passage(pairs: DataFrame, articles: DataFrame, most: int = 1000) -> DataFrame:
    """(claim_id, article_id, passage, source): a stretch of an article's body for each claim and candidate text.

    pairs: (claim_id, claim_text, article_id, candidate). The sentence is the one in which the candidate text stands, in
    any case, or else the first of those that share most words of three letters with claim and candidate. It comes with
    the sentences beside it up to `most` characters; a longer one is cut, from 200 characters before the candidate text.
    Without a body the candidate text is returned.
    """
    from pyspark.sql import Window as W

    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w{3,}"), F.lit(0)))
    bodies = articles.select("article_id", F.col("content").alias("body"))
    in_text = W.partitionBy("article_id").orderBy("pos")
    spans = bodies.select("article_id", F.posexplode(F.regexp_extract_all("body", F.lit(_SENTENCE), F.lit(0))).alias("pos", "part"))
    spans = spans.select("article_id", "pos", words(F.col("part")).alias("words"), F.length("part").alias("n"), F.length(F.regexp_replace("part", r"(?U)^\s+", "")).alias("own"))
    spans = spans.withColumn("end", F.sum("n").over(in_text.rowsBetween(W.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("own"))
    spans = spans.withColumns({"before": F.lag("start").over(in_text), "after": F.lead("end").over(in_text)})

    held = pairs.join(bodies, "article_id", "left")
    found = F.when(F.length("candidate") > 0, F.expr("locate(lower(candidate), lower(body))"))  # from 1; 0 for none
    terms = words(F.concat_ws(" ", "candidate", "claim_text"))
    asked = held.select("claim_id", "article_id", "candidate", F.coalesce(found, F.lit(0)).alias("anchor"), terms.alias("terms"))
    fit = F.when(F.col("anchor") > 0, (F.col("end") >= F.col("anchor")).cast("int")).otherwise(F.size(F.array_intersect("terms", "words")))
    met = asked.join(spans, "article_id", "left")  # every join is on article_id: one shuffle
    text = F.when(F.col("pos").isNull(), F.col("candidate")).alias("candidate")
    met = met.select("claim_id", "article_id", fit.alias("fit"), "pos", F.struct("start", "end", "before", "after", "anchor", text).alias("x"))  # no words go into the sort
    best = met.groupBy("claim_id", "article_id").agg(F.max_by("x", F.struct("fit", -F.col("pos"))).alias("x")).select("claim_id", "article_id", "x.*")

    long = F.col("end") - F.col("start") > most
    first = F.when(long, F.when(F.col("anchor") > 0, F.greatest("start", F.col("anchor") - 201)).otherwise(F.col("start")))
    first = first.when(F.col("end") - F.col("before") <= most, F.col("before")).otherwise(F.col("start"))
    last = F.when(long, F.col("first") + most).when(F.col("after") - F.col("first") <= most, F.col("after")).otherwise(F.col("end"))
    best = best.withColumn("first", first).withColumn("last", last).select("claim_id", "article_id", "candidate", "first", "last")
    rows = best.join(bodies, "article_id", "left")
    part = F.regexp_replace(F.substr("body", (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first")).cast("int")), r"(?U)^\s+|\s+$", "")
    bare = F.col("first").isNull()
    return rows.select("claim_id", "article_id", F.when(bare, F.col("candidate")).otherwise(part).alias("passage"), F.when(bare, "extracted_claim").otherwise("content").alias("source"))


_TOKENS = ["__ta", "__tb", "__sa", "__sb"]


def with_change_kinds(pairs: DataFrame) -> DataFrame:
    """pairs with `kinds`, the kinds of change from older text a to newer text b, an array: those whose tokens differ as
    multisets. The tokens of each text, which follow in the columns _TOKENS, are cut once for all kinds."""
    cut = pairs.withColumns({"__ta": tx.tokens(F.col("a")), "__tb": tx.tokens(F.col("b")), "__sa": tx.surface_tokens(F.col("a")), "__sb": tx.surface_tokens(F.col("b"))})
    kinds = [("NUMERIC_DRIFT", "t", tx.numeric_among), ("ENTITY_SUBSTITUTION", "s", tx.entities_among)]
    kinds += [(n, "t", lambda c, k=k: tx.lexicon_among(c, k)) for n, k in (("POLARITY_SHIFT", "polarity"), ("HEDGING_SHIFT", "hedge"), ("ATTRIBUTION_SHIFT", "attribution"), ("SCOPE_SHIFT", "scope"))]
    differ = [F.when(F.sort_array(f(F.col(f"__{of}a"))) != F.sort_array(f(F.col(f"__{of}b"))), F.lit(n)) for n, of, f in kinds]
    return cut.withColumn("kinds", F.array_compact(F.array(*differ)))


def text_change(pairs: DataFrame) -> DataFrame:
    """Kinds of change between older and newer text (a, b), by comparing each lexicon's tokens; NEAR_DUPLICATE if none."""
    sets = pairs.withColumns({"__wa": tx.token_set(F.col("a")), "__wb": tx.token_set(F.col("b"))})
    rows = with_change_kinds(sets).withColumns({"overlap": tx.jaccard(F.col("__wa"), F.col("__wb"), 1.0), "same": F.array_join("__ta", " ") == F.array_join("__tb", " ")})
    style = F.when(F.col("overlap") < 0.65, F.array(F.lit("FRAMING_SHIFT"))).when((F.col("overlap") < 0.9) | (F.size("kinds") == 0), F.array(F.lit("WORDING_DRIFT"))).otherwise(F.array().cast("array<string>"))
    types = F.when(F.col("same"), F.array(F.lit("NEAR_DUPLICATE"))).otherwise(F.concat("kinds", style))
    return rows.withColumn("types", F.array_join(types, ",")).withColumn("meaningful", ~F.col("same")).drop("kinds", "same", "__wa", "__wb", *_TOKENS)


def claim_graph(claims: DataFrame, relations: DataFrame, limit: int, k: int) -> DataFrame:
    """(from_id, to_id, kind, source) among the `limit` most confident claims (claim_id, confidence, v; nulls last).

    Relations between them are `persisted`; only if there are none, each claim's k nearest others are `nearest`.
    """
    top = stage(claims.orderBy(F.col("confidence").desc_nulls_last(), "claim_id").limit(limit), "graph-claims")
    ids = top.select("claim_id")
    held = relations.join(ids.toDF("from_id"), "from_id", "left_semi").join(ids.toDF("to_id"), "to_id", "left_semi")
    held = stage(held.select("from_id", "to_id", "kind", F.lit("persisted").alias("source")), "graph-edges")
    if not held.isEmpty():
        return held
    found = vectors.nearest(top.select(F.col("claim_id").alias("q"), F.col("v").alias("qv")), top.select(F.col("claim_id").alias("id"), "v"), k)
    pairs = vectors.undirected_best(found)
    return pairs.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit("SIMILAR_TO").alias("kind"), F.lit("nearest").alias("source"))
