"""Word lists and constants that results depend on."""

HEDGE_WORDS = (
    "allegedly reportedly unverified claimed claims rumored rumoured rumour rumor purportedly seemingly apparently may "
    "might could possibly perhaps sources according believed suspected speculation unconfirmed likely unlikely probably "
    "potentially estimated"
).split()
POLARITY_WORDS = (
    "not no never neither nor without deny denies denied false untrue cannot can't won't isn't aren't wasn't weren't "
    "doesn't didn't don't hasn't haven't hadn't couldn't wouldn't shouldn't mustn't"
).split()
ATTRIBUTION_WORDS = (
    "according sources source said says say stated states reported reports report claimed claims announced announces "
    "cited cites told spokesperson"
).split()
SCOPE_PHRASES = ["at least", "at most", "more than", "less than", "up to"]
SCOPE_WORDS = (
    "all every everyone everything any some many most few several none only each both entire always sometimes often "
    "everywhere nationwide worldwide globally locally approximately about nearly over under"
).split()
STOP_WORDS = (
    "the a an in on at to for of and or is are was were it its as by with from that this has have had but will after "
    "before into than then new first officials president"
).split()
#: Substrings that lower a claim's language signal.
HEDGE_TERMS = ["reportedly", "allegedly", "rumor", "rumour", "unconfirmed", "sources say", "it is said", "claims", "supposedly", "appears to"]
SENSATION_TERMS = ["shocking", "bombshell", "exposed", "conspiracy", "secret", "they don't want you", "wake up", "mainstream media"]
REPORTING_TERMS = ["said", "according to", "announced", "reported", "confirmed", "stated"]
OPINION_TERMS = [" i ", " my ", " we ", " our ", "think", "feel", "love", "hate", "ridiculous"]
STRONG_ENTITY_TYPES = ["PERSON", "ORG", "GPE", "LOC", "DATE", "CARDINAL", "MONEY", "QUANTITY", "TIME", "PERCENT"]
STATUSES = ["raw", "processing", "processed", "skipped_non_english", "failed"]
#: Signal weights of the pooled score.
WEIGHTS = {"corroboration": 0.40, "contradiction": 0.20, "track_record": 0.15, "entity_grounding": 0.15, "language": 0.10}
#: Similarity buckets, half-open from below.
BUCKETS = [(0.95, "b95"), (0.85, "b85"), (0.75, "b75"), (0.60, "b60"), (0.40, "b40"), (-1.01, "b00")]
