"""News items, answers to questions about them, and the features made of those.

Items are documents, answers are turns of conversations; an answer's probabilities follow from its keys."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..fixtures import matches, table
from ..functions import text
from ..operators.lineage import cut
from .ledger import digest_in_parts, digest_sql
from .registry import query

#: Names of the twelve teams (fixed values of the fixture).
TEAMS = ("That United", "With City", "Tion F.C.", "Therea Royal", "Able Athletic", "Unge Sporting", "Keit Club", "Sche Real", "Menta Olympique", "Thisth Town", "Ción Deportivo", "Ador Onen")
HORIZON, SPAN, MOST_FIXTURES, MOST_EARLIER = 8, 72, 6, 8
_GENERIC = ", ".join(f"'{w}'" for w in text.GENERIC)
_TOKEN = f"""words AS (SELECT team, list_filter(regexp_split_to_array(strip_accents(lower(name)), '[^a-z]+'), lambda w: w NOT IN ('', 'f',
    'c')) AS w FROM (VALUES {', '.join(f"({i}, '{t}')" for i, t in enumerate(TEAMS))}) t(team, name)),
tokens AS (SELECT team, unnest(CASE WHEN len(own) > 0 THEN own ELSE w END) AS token FROM (SELECT *, list_filter(w, lambda x: length(x) >= 4
    AND x NOT IN ({_GENERIC})) AS own FROM words) u)"""
_ITEM = "items AS (SELECT doc_id, (doc_id * 7) % 5000 AS hour, date '1996-01-01' + ((doc_id * 7) % 5000 // 24)::int AS day, text FROM documents)"
_MENTION = f"""{_ITEM}, {_TOKEN}, mention AS (SELECT DISTINCT doc_id, hour, day, team
    FROM (SELECT doc_id, hour, day, unnest(list_distinct(regexp_split_to_array(strip_accents(lower(text)), '[^a-z]+'))) AS word
    FROM items) w JOIN tokens ON starts_with(word, token))"""


def token_table(spark, names=TEAMS):
    """(team, token): the words of each team's name that tell it apart."""
    teams = spark.createDataFrame(list(enumerate(names)), "team long, name string")
    return teams.select("team", F.explode(text.team_tokens(F.col("name"))).alias("token"))


def mentions(spark, sf, names=TEAMS):
    """(doc_id, hour, day, team): teams of whose tokens one begins a word of the text. Every word is looked up by its
    beginnings of just the lengths that tokens have, so the lookup is a join on equal keys."""
    tokens = token_table(spark, names)
    lengths = sorted(r["n"] for r in tokens.select(F.char_length("token").alias("n")).distinct().limit(100).collect())  # lengths of words in names
    d = table(spark, sf, "documents").withColumn("hour", (F.col("doc_id") * 7) % 5000)
    words = F.array_distinct(F.split(text.unmarked(F.lower("text")), "[^a-z]+"))
    begun = lambda n: F.transform(F.filter(words, lambda w: F.char_length(w) >= n), lambda w: F.left(w, F.lit(n)))
    starts = [begun(n) for n in lengths]
    x = d.select("doc_id", "hour", F.date_add(F.lit("1996-01-01").cast("date"), F.floor(F.col("hour") / 24).cast("int")).alias("day"), F.explode(F.array_distinct(F.concat(*starts))).alias("token"))
    return x.join(F.broadcast(tokens), "token").select("doc_id", "hour", "day", "team").distinct()  # a row a word of a team's name


@query("n2_mentions", f"WITH {_MENTION} SELECT team, count(*) AS n FROM mention GROUP BY 1")
def mention_counts(spark, sf):
    return mentions(spark, sf).groupBy("team").agg(F.count(F.lit(1)).alias("n"))


@query("j9_candidate_fixtures", f"""WITH {_MENTION}, fx AS (SELECT match_id, match_date, home AS team FROM fx_match UNION
    SELECT match_id, match_date, away FROM fx_match),
c AS (SELECT doc_id, match_id, match_date, count(*) AS hits FROM mention m JOIN fx ON fx.team = m.team AND fx.match_date > m.day
    AND fx.match_date <= m.day + 8 GROUP BY 1, 2, 3)
SELECT doc_id, match_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, match_date, match_id) AS k
    FROM c) t WHERE k <= 6""", "match")
def candidate_fixtures(spark, sf):
    return next_fixtures(mentions(spark, sf), matches(spark, sf))


def next_fixtures(mentioned, fixtures):
    """Fixtures of mentioned teams in the eight days after an item: days are spread out, so the range is an equi-join.

    A fixture has two hits if both its teams are mentioned. An item's first six are among the first six of each day
    and pair of mentioned teams and the first six of each day and mentioned team, so no more than those are joined."""
    day = Window.partitionBy("match_date", "key").orderBy("match_id")
    home, away = F.col("home"), F.col("away")
    keys = F.array_distinct(F.array(F.array(home), F.array(away), F.array_sort(F.array(home, away))))
    fx = fixtures.select("match_id", "match_date", F.array_distinct(F.array(home, away)).alias("sides"), F.explode(keys).alias("key"))
    fx = fx.withColumn("k", F.row_number().over(day)).where(F.col("k") <= MOST_FIXTURES).drop("k")
    m = mentioned.groupBy("doc_id", "day").agg(F.array_sort(F.collect_set("team")).alias("teams"))
    pairs = F.flatten(F.transform("teams", lambda a: F.transform(F.filter("teams", lambda b: b >= a), lambda b: F.array_distinct(F.array(a, b)))))
    m = m.select("*", F.explode(pairs).alias("key")).withColumn("match_date", F.explode(F.transform(F.sequence(F.lit(1), F.lit(HORIZON)), lambda i: F.date_add(F.col("day"), i))))
    c = m.join(fx, ["key", "match_date"]).select("doc_id", "match_id", "match_date", F.size(F.array_intersect("teams", "sides")).cast("long").alias("hits")).distinct()
    w = Window.partitionBy("doc_id").orderBy(F.desc("hits"), "match_date", "match_id")
    return c.withColumn("k", F.row_number().over(w)).where(F.col("k") <= MOST_FIXTURES).select("doc_id", "match_id", "hits")


@query("j10_cluster_candidates", f"""WITH {_MENTION}, c AS (SELECT DISTINCT a.doc_id, b.doc_id AS earlier, b.hour FROM mention a
    JOIN mention b ON a.team = b.team AND (b.hour, b.doc_id) < (a.hour, a.doc_id) AND b.hour >= a.hour - 72)
SELECT doc_id, earlier FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hour DESC, earlier DESC) AS k FROM c) t WHERE k <= 8""")
def cluster_candidates(spark, sf):
    """The eight newest earlier items on a shared team within 72 hours. The newest of all are among the newest of
    each team, so a window of eight rows a team gives them without a self join."""
    w = Window.partitionBy("team").orderBy("hour", "doc_id").rowsBetween(-MOST_EARLIER, -1)
    x = mentions(spark, sf).withColumn("before", F.collect_list(F.struct("hour", "doc_id")).over(w))
    x = x.select("doc_id", F.filter("before", lambda b: b["hour"] >= F.col("hour") - SPAN).alias("before"))
    x = x.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("before"))).alias("b"))
    return x.select("doc_id", F.explode(F.slice(F.sort_array("b", asc=False), 1, MOST_EARLIER)["doc_id"]).alias("earlier"))


@query("n1_available_at", """SELECT doc_id, greatest((doc_id * 7) % 5000, CASE
    WHEN doc_id % 3 <> 0 THEN (doc_id * 11) % 5000 END) AS observed, CASE WHEN doc_id % 3 <> 0 THEN (doc_id * 11) % 5000 + 6 END AS archived
    FROM documents""")
def available_at(spark, sf):
    """Observed items: the later of now and the claim; archived ones: the claim and a lag."""
    claim = F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") * 11) % 5000)
    return table(spark, sf, "documents").select("doc_id", F.greatest((F.col("doc_id") * 7) % 5000, claim).alias("observed"), (claim + 6).alias("archived"))


LEVELS = {"none": 0.0, "low": 1 / 3, "medium": 2 / 3, "high": 1.0}
_ANSWER = """answers AS (SELECT conv_id, turn, role, conv_id % 11 = 0 AS alien, (1 + (conv_id + turn) % 4)::double AS w0, (1 + (conv_id *
    3 + turn) % 5)::double AS w1, (1 + (conv_id + turn * 2) % 3)::double AS w2, (1 + (conv_id * 2 + turn * 5) % 6)::double AS w3,
 CASE WHEN conv_id % 13 = 0 AND turn = 0 THEN NULL ELSE ((conv_id * 3 + turn) % 10) / 10.0E0 END AS confidence
    FROM conversations), shared AS (SELECT *, w0 + w1 + w2 + w3 AS s FROM answers)"""
_VALUE = "(w1/s * (1/3::double) + w2/s * (2/3::double) + w3/s)"


def answers(spark, sf):
    """(conv_id, turn, role, p, confidence): probabilities by option; every eleventh item has an unknown option."""
    c, t = F.col("conv_id"), F.col("turn")
    w = [1.0 + (c + t) % 4, 1.0 + (c * 3 + t) % 5, 1.0 + (c + t * 2) % 3, 1.0 + (c * 2 + t * 5) % 6]
    x = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.array(*w).alias("w"), F.when((c % 13 == 0) & (t == 0), None).otherwise(((c * 3 + t) % 10) / 10.0).alias("confidence"))
    s = F.aggregate("w", F.lit(0.0), lambda a, v: a + v)
    names = F.array(F.lit("none"), F.lit("low"), F.lit("medium"), F.when(c % 11 == 0, "other").otherwise("high"))
    return x.withColumn("p", F.map_from_arrays(names, F.transform("w", lambda v: v / s))).drop("w")


def valid_answer(p: Column, options) -> Column:
    """Known options only, each finite and in [0, 1], and at least one."""
    fine = F.forall(F.map_values(p), lambda v: v.isNotNull() & ~F.isnan(v) & v.between(0, 1))
    return F.coalesce((F.size(p) > 0) & (F.size(F.array_except(F.map_keys(p), F.array(*map(F.lit, options)))) == 0) & fine, F.lit(False))


def level_value(p: Column, confidence: Column) -> Column:
    """Mean level by probability; null for an answer that isn't valid."""
    score = F.create_map(*[F.lit(v) for k in LEVELS.items() for v in k])
    both = F.aggregate(F.map_entries(p), F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("t")), lambda a, e: F.struct((a["v"] + score[e["key"]] * e["value"]).alias("v"), (a["t"] + e["value"]).alias("t")), lambda a: F.when(a["t"] > 0, a["v"] / a["t"]))
    return F.when(valid_answer(p, LEVELS) & confidence.isNotNull(), both)


@query("n3_answer_validity", f"WITH {_ANSWER} SELECT role, count(*) AS n, count(*) FILTER (NOT alien) AS valid FROM shared GROUP BY 1")
def answer_validity(spark, sf):
    return answers(spark, sf).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(valid_answer(F.col("p"), LEVELS)).alias("valid"))


@query("n8_level_answer", f"WITH {_ANSWER} SELECT conv_id, turn, CASE WHEN NOT alien AND confidence IS NOT NULL THEN round({_VALUE}, 6) END AS level FROM shared")
def level_answer(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", F.round(level_value(F.col("p"), F.col("confidence")), 6).alias("level"))


_GATE = """SELECT conv_id, round(max(CASE WHEN turn % 3 = 0 THEN (w1 + w2) / s END), 6) AS belongs, round(max(CASE
    WHEN turn % 3 = 1 THEN (w2 + w3) / s END), 6) AS reliability, max(turn) AS asked_at FROM shared WHERE NOT alien AND turn < {limit}
    GROUP BY 1"""


def gates(rows, before: int):
    """One row an item: shares of the options that count for each question, and the last question's place."""
    share = lambda q, *keys: F.round(F.max(F.when(F.col("turn") % 3 == q, sum((F.col("p")[k] for k in keys[1:]), F.col("p")[keys[0]]))), 6)
    x = rows.where(valid_answer(F.col("p"), LEVELS) & (F.col("turn") < before))
    return x.groupBy("conv_id").agg(share(0, "low", "medium").alias("belongs"), share(1, "medium", "high").alias("reliability"), F.max("turn").alias("asked_at"))


@query("n4_gate_summary", f"WITH {_ANSWER} {_GATE.format(limit=1000000)}")
def gate_summary(spark, sf):
    return gates(answers(spark, sf), 1_000_000)


@query("n6_gates_as_of", f"WITH {_ANSWER} {_GATE.format(limit=2)}")
def gates_as_of(spark, sf):
    return gates(answers(spark, sf), 2)


@query("n9_feature_vector", f"""WITH {_ANSWER}, v AS (SELECT conv_id, turn % 3 AS q, role, max(CASE WHEN NOT alien
    AND confidence >= 0.2 THEN {_VALUE} END) AS v FROM shared GROUP BY 1, 2, 3),
f AS (SELECT conv_id, q, max(v) FILTER (role = 'user') - coalesce(max(v) FILTER (role = 'assistant'), 0) AS f FROM v GROUP BY 1, 2)
SELECT conv_id, round(coalesce(sum(f) FILTER (q = 0), 0), 6) AS f0, round(coalesce(sum(f) FILTER (q = 1), 0), 6) AS f1,
    round(coalesce(sum(f) FILTER (q = 2), 0), 6) AS f2, 3 - count(f) AS missing FROM f GROUP BY 1""")
def feature_vector(spark, sf):
    """Home less away for three questions; a side that wasn't asked counts as none, a missing feature as 0."""
    x = answers(spark, sf).withColumn("v", F.when(F.col("confidence") >= 0.2, level_value(F.col("p"), F.col("confidence"))))
    best = lambda q, role: F.max(F.when((F.col("turn") % 3 == q) & (F.col("role") == role), F.col("v")))
    raw = x.groupBy("conv_id").agg(*[(best(q, "user") - F.coalesce(best(q, "assistant"), F.lit(0.0))).alias(f"r{q}") for q in range(3)])
    none = sum((F.col(f"r{q}").isNull().cast("long") for q in range(1, 3)), F.col("r0").isNull().cast("long"))
    return raw.select("conv_id", *[F.round(F.coalesce(f"r{q}", F.lit(0.0)), 6).alias(f"f{q}") for q in range(3)], none.alias("missing"))


#: Outcomes of a side, the first that occurs wins (fixed values).
OUTCOMES = ("asked", "no_news", "stale", "deferred", "error", "budget", "outage", "model_drift")


@query("n10_final_status", f"""SELECT user_id, list_extract({list(OUTCOMES)!r}, min(place)::int) AS status
    FROM (SELECT user_id, 1 + (user_id * 5 + length(event_type)) % 8 AS place FROM events) t GROUP BY 1""")
def final_status(spark, sf):
    """All events; a place follows from the user and the kind of event."""
    return first_status(table(spark, sf, "events"), F.col("user_id") * 5 + F.length("event_type"))


def first_status(events, place):
    order = F.array(*map(F.lit, OUTCOMES))
    x = events.withColumn("status", F.get(order, (place % 8).cast("int")))
    return x.groupBy("user_id").agg(F.min(F.array_position(order, F.col("status"))).alias("k")).select("user_id", F.element_at(order, F.col("k").cast("int")).alias("status"))


_TRIES = "tries AS (SELECT user_id, count(*) AS attempts, count(*) FILTER (event_type = 'error') AS failed, max(event_id) AS last_id FROM events GROUP BY 1)"


def tries(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("event_type") == "error").alias("failed"), F.max("event_id").alias("last_id"))


@query("a37_attempts", "SELECT user_id, event_type, count(*) AS attempts FROM events GROUP BY 1, 2")
def attempts(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("attempts"))


@query("n12_retry_rule", f"WITH {_TRIES} SELECT user_id, CASE WHEN failed >= 3 THEN 'given_up' WHEN failed > 0 THEN 'retry' ELSE 'fine' END AS verdict FROM tries")
def retry_rule(spark, sf):
    return tries(spark, sf).select("user_id", F.when(F.col("failed") >= 3, "given_up").when(F.col("failed") > 0, "retry").otherwise("fine").alias("verdict"))


@query("n11_work_selection", f"""WITH {_TRIES}, s AS (SELECT user_id, last_id, CASE WHEN failed >= 40 THEN 'answered'
    WHEN attempts < 30 THEN 'no_news' WHEN last_id % 5 = 0 THEN 'stale' END AS reason FROM tries) SELECT user_id, coalesce(reason, CASE
    WHEN row_number() OVER (PARTITION BY user_id % 8, reason ORDER BY last_id) > 2 THEN 'deferred' ELSE 'ask' END) AS status FROM s""")
def work_selection(spark, sf):
    """Why a key isn't asked; of the rest each shard asks its first two and defers the others."""
    x = tries(spark, sf).withColumn("reason", F.when(F.col("failed") >= 40, "answered").when(F.col("attempts") < 30, "no_news").when(F.col("last_id") % 5 == 0, "stale"))
    k = F.row_number().over(Window.partitionBy(F.col("user_id") % 8, "reason").orderBy("last_id"))
    return x.select("user_id", F.coalesce("reason", F.when(k > 2, "deferred").otherwise("ask")).alias("status"))


def roots(parents, most: int = 40):
    """(id, root) of (id, parent): every round doubles the distance that pointers cover. Only pointers to smaller ids
    count, so there are no cycles."""
    x = cut(parents.select("id", F.when(F.col("parent") < F.col("id"), F.col("parent")).otherwise(F.col("id")).alias("to")))
    for _ in range(most):
        far = x.select(F.col("id").alias("to"), F.col("to").alias("next"))
        y = cut(x.join(far, "to", "left").select("id", F.coalesce("next", "to").alias("to")))
        if y.join(x, ["id", "to"], "left_anti").isEmpty():
            break
        x = y
    return x.select("id", F.col("to").alias("root"))


_GROUP = "coalesce(source, '') || '|' || coalesce(lang, '')"


@query("n5_cluster_root", f"""SELECT doc_id AS id, max(CASE WHEN first_in OR doc_id % 5 = 0 THEN doc_id END) OVER (PARTITION BY g
    ORDER BY doc_id) AS root FROM (SELECT doc_id, {_GROUP} AS g, row_number() OVER (PARTITION BY {_GROUP} ORDER BY doc_id) = 1 AS first_in
    FROM (SELECT DISTINCT doc_id, source, lang FROM documents) d) t""")
def cluster_root(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang").distinct()
    before = F.lag("doc_id").over(Window.partitionBy(F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).orderBy("doc_id"))
    return roots(d.select(F.col("doc_id").alias("id"), before.alias("before")).select("id", F.when(F.col("id") % 5 != 0, F.col("before")).alias("parent")))


@query("n7_side_tasks", f"""WITH {_MENTION}, t AS (SELECT md5(i.text) AS content, m.team, m.day, min(m.doc_id) AS doc_id FROM mention m
    JOIN items i USING (doc_id) GROUP BY 1, 2, 3)
SELECT team, day, n AS items, digest AS set_hash FROM
    ({digest_sql('team, day', 'substr(content, 1, 3)', 'content', 'content', '(SELECT team, day::varchar AS day, content FROM t) s')}) q""")
def side_tasks(spark, sf):
    """Items of a team and day, each content once, with the hash of their set."""
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("content"))
    x = mentions(spark, sf).join(d, "doc_id").select("team", "day", "content").distinct()
    x = digest_in_parts(x.withColumn("day", F.col("day").cast("string")), ["team", "day"], F.substring("content", 1, 3), F.col("content"))
    return x.select("team", "day", F.col("n").alias("items"), F.col("digest").alias("set_hash"))


@query("a36_volume_estimate", f"""WITH {_MENTION}, d AS (SELECT day, count(DISTINCT doc_id) AS items, count(*) AS calls FROM mention
    WHERE day >= date '1996-01-01' AND day < date '1996-01-29' GROUP BY 1)
    SELECT sum(items)::bigint AS items, sum(calls)::bigint AS calls, round(sum(calls) * 0.002E0, 6) AS cost, sum(calls) > 5000 AS stop
    FROM d""")
def volume_estimate(spark, sf):
    """Calls and cost over 28 days and whether the stop rule holds."""
    d = mentions(spark, sf).where("day >= date '1996-01-01' and day < date '1996-01-29'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("calls")).select("items", "calls", F.round(F.col("calls") * 0.002, 6).alias("cost"), (F.col("calls") > 5000).alias("stop"))


_PRED = """p AS (SELECT lang, quality AS truth, (n_chars BETWEEN 200 AND 20000)::int AS guess, (1 + doc_id % 9) / 10.0E0 AS confidence
    FROM documents JOIN labels USING (doc_id))"""


@query("a33_classifier_scores", f"""WITH {_PRED} SELECT lang, count(*) AS n, round(avg((truth = guess)::int), 6) AS accuracy, count(*)
    FILTER (guess = 1 AND truth = 0) AS fp, count(*) FILTER (guess = 0
    AND truth = 1) AS fn, round(avg(confidence), 6) AS confidence, count(*) >= 100 AND avg((truth = guess)::int) >= 0.85 AS ready FROM p
    GROUP BY 1""")
def classifier_scores(spark, sf):
    x = table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").between(200, 20000).cast("int").alias("guess")).join(table(spark, sf, "labels"), "doc_id")
    right = (F.col("quality") == F.col("guess")).cast("int")
    out = x.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("acc"), F.count_if((F.col("guess") == 1) & (F.col("quality") == 0)).alias("fp"), F.count_if((F.col("guess") == 0) & (F.col("quality") == 1)).alias("fn"), F.round(F.avg((1 + F.col("doc_id") % 9) / 10.0), 6).alias("confidence"))
    return out.select("lang", "n", F.round("acc", 6).alias("accuracy"), "fp", "fn", "confidence", ((F.col("n") >= 100) & (F.col("acc") >= 0.85)).alias("ready"))


@query("j15_label_side_table", "SELECT d.lang, count(*) AS n, count(*) FILTER (l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def label_side_table(spark, sf):
    """Labels beside their texts; ids without one are counted, for the caller to refuse."""
    x = table(spark, sf, "documents").join(table(spark, sf, "labels").withColumn("found", F.lit(True)), "doc_id", "left")
    return x.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("found").isNull()).alias("missing"))
