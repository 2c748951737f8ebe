"""Names, slugs, rule cascades and predicates over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table
from ..functions import text as T
from .registry import query

_TAIL = (" F.K.", " FC", " Spor Kulübü", " A.Ş.", "", " İL", " S.K. Çağ")
_NAME = f"names AS (SELECT p_partkey, p_name || (CASE p_partkey % 7 {' '.join(f'WHEN {i} THEN {t!r}' for i, t in enumerate(_TAIL))} END) AS name FROM part)"
_EDGE = "[^a-z0-9ğüşıöç]"
_KEY = f"trim(regexp_replace(replace(regexp_replace(regexp_replace(' ' || lower(replace(replace({{x}}, 'İ', 'i'), 'I', 'ı')) || ' ', '({_EDGE}){T.SUFFIXES}({_EDGE})', ' ', 'g'), '[^{T.KEY_LETTERS}]+', ' ', 'g'), 'ı', 'i'), ' +', ' ', 'g'))"
_BARE = "strip_accents({x})"


def names(spark, sf):
    tails = F.array(*map(F.lit, _TAIL))
    return table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.get(tails, (F.col("p_partkey") % len(_TAIL)).cast("int"))).alias("name"))


@query("p12_team_key", f"WITH {_NAME} SELECT p_partkey, {_KEY.format(x='name')} AS team_key FROM names")
def team_key(spark, sf):
    return names(spark, sf).select("p_partkey", T.normalise_team(F.col("name")).alias("team_key"))


@query("p13_fold", f"WITH {_NAME} SELECT p_partkey, {_KEY.format(x=_BARE.format(x='name'))} AS folded FROM names")
def fold(spark, sf):
    return names(spark, sf).select("p_partkey", T.fold(F.col("name")).alias("folded"))


@query("p14_slug", f"WITH {_NAME} SELECT p_partkey, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM names")
def slug(spark, sf):
    return names(spark, sf).select("p_partkey", T.slug(F.col("name")).alias("slug"))


@query("p18_source_policy", """SELECT lang, count(*) AS n FROM documents WHERE source NOT IN (SELECT source FROM documents GROUP BY source
    HAVING avg(n_chars) > 1000 AND max(doc_id) % 2 = 0) GROUP BY 1""")
def source_policy(spark, sf):
    """Items of sources that the policy table doesn't close; the policy comes from the sources' own figures."""
    d = table(spark, sf, "documents")
    closed = d.groupBy("source").agg(F.avg("n_chars").alias("mean"), F.max("doc_id").alias("last")).where("mean > 1000 and last % 2 = 0")
    return d.where("source is not null").join(closed, "source", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("p20_label_phrase", """SELECT p_partkey FROM part WHERE regexp_matches(' ' || lower(p_name) || ' ', ' widget ')
    AND NOT regexp_matches(' ' || lower(p_name) || ' ', ' (cold|hot) ')""")
def label_phrase(spark, sf):
    return table(spark, sf, "part").where(T.has_phrase(F.col("p_name"), "widget", ("cold", "hot"))).select("p_partkey")


_KIND = """CASE p_partkey % 9 WHEN 0 THEN p_partkey || '.-TL PARA CEZASI ve İHTAR CEZASI'
    WHEN 1 THEN p_size || ' RESMİ MÜSABAKADAN MEN CEZASI' WHEN 2 THEN '(3-0) HÜKMEN MAĞLUP' WHEN 3 THEN 'İHTAR CEZASI' ELSE p_name END"""


@query("s10_sanction_rules", """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'para' WHEN 1 THEN 'men' WHEN 2 THEN 'hukmen_maglubiyet'
    WHEN 3 THEN 'ihtar' ELSE 'other' END AS kind, CASE p_partkey % 9 WHEN 0 THEN p_partkey::varchar WHEN 1 THEN p_size::varchar
    WHEN 2 THEN '3-0' END AS amount FROM part""")
def sanction_rules(spark, sf):
    x = table(spark, sf, "part").select("p_partkey", T.sanction(F.expr(_KIND)).alias("s"))
    return x.select("p_partkey", "s.kind", "s.amount")


@query("q6_text_hygiene", """SELECT source, count(*) FILTER (regexp_matches(text, 'https?://')) AS links, count(*) FILTER
    (regexp_matches(text, '<[A-Za-z/!][^>]*>')) AS markup, count(*) FILTER (regexp_matches(text,
    '(AKIA[A-Z0-9]{12,}|[A-Za-z0-9._-]+@[A-Za-z0-9.-]+)')) AS credentials FROM documents GROUP BY 1""")
def text_hygiene(spark, sf):
    """Texts with links, markup or credential patterns, by source."""
    t = F.col("text")
    rules = {"links": "https?://", "markup": "<[A-Za-z/!][^>]*>", "credentials": r"(AKIA[A-Z0-9]{12,}|[A-Za-z0-9._-]+@[A-Za-z0-9.-]+)"}
    return table(spark, sf, "documents").groupBy("source").agg(*[F.count_if(t.rlike(p)).alias(k) for k, p in rules.items()])
