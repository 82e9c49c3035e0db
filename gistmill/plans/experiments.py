"""Approximate search, retrieval with a fallback, and experiments on made reports."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kept import kept, shared_dir
from ..operators import claims as C
from ..operators import experiment as X
from ..operators import models as M
from ..operators import phases as H
from ..operators import retrieval as R
from ..operators import synthesis as Y
from ..session import load
from . import standins as S
from .registry import SQL, query
from .texts import STRIP, WS


def _index(spark: SparkSession, sf_dir: str) -> tuple[R.Index, DataFrame]:
    e = load(spark, sf_dir, "embeddings")
    return R.Index.build(e, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", "vec_id", "embedding"), e


@query()
def nearest_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to every hundredth one, from some of an inverted file's cells; recall is tested.

    The given vectors have hardly any clusters, so it takes five of eight cells to find nine of ten neighbours.
    """
    index, e = _index(spark, sf_dir)
    found = index.search(e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10, -(-len(index.middle) * 5 // 8))
    return found.withColumnRenamed("key", "vec_id")


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE len(list_filter(embedding, lambda c: c <> 0)) > 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.x, c.x), 9) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10""")
def nearest_in_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all cells probed, which is exact."""
    index, e = _index(spark, sf_dir)
    found = index.search(e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10, len(index.middle))
    return found.select("query_id", "rank", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


#: Source records made of documents: three platforms by id, the first line the title.
CORPUS = "corpus AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'stackoverflow' ELSE 'juejin' END AS platform, coalesce(split_part(text, chr(10), 1), '') AS title, coalesce(text, '') AS content FROM documents)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    platform = F.when(i % 3 == 0, "github").when(i % 3 == 1, "stackoverflow").otherwise("juejin")
    return load(spark, sf_dir, "documents").select(i.alias("id"), platform.alias("platform"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("content"))


def _tidy(text: str, limit: int) -> str:
    return f"""rtrim(left(replace({STRIP(f"regexp_replace({text}, '{WS}+', ' ', 'g')")}, '"', ''''), {limit}))"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _made_sql() -> str:
    """The reports as SQL, from the same fixed texts."""
    pad = f"chr(10) || chr(10) || {_quoted(Y.FILLER)}"
    padded = lambda body, least: f"{body} || repeat({pad}, CAST(greatest(ceil(({least} - length({body})) / {len(Y.FILLER) + 2}.0), 0) AS INTEGER))"
    either = lambda k: f"CASE WHEN idx % 2 = 1 THEN {_case(Y.FLAWED, k)} ELSE {_case(Y.CLEAN, k)} END"
    return f"""{CORPUS},
n AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY id) - 1 AS nth FROM corpus),
p AS (SELECT a.platform, a.nth // 2 AS idx, a.id AS id1, b.id AS id2, {_tidy("a.title", 100)} AS t1, {_tidy("b.title", 100)} AS t2, {_tidy("a.content", 150)} AS detail,
  row_number() OVER (ORDER BY CASE a.platform WHEN 'github' THEN 0 WHEN 'stackoverflow' THEN 1 ELSE 2 END, a.nth) - 1 AS ordinal FROM n a JOIN n b ON a.platform = b.platform AND a.nth % 2 = 0 AND b.nth = a.nth + 1),
v AS (SELECT *, idx % 2 = 1 AS flagged, idx % 10 < 6 AS listed, CASE ordinal % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END AS length_bucket, {either(0)} AS mutation_type, {either(1)} AS verdict,
  'The first source is titled "' || t1 || '".' AS one, 'The source states: "' || detail || '".' AS two, CASE platform WHEN 'github' THEN 'Juejin' WHEN 'stackoverflow' THEN 'GitHub' ELSE 'Stack Overflow' END AS wrong FROM p),
q AS (SELECT *, CASE mutation_type WHEN 'supported_control' THEN 'The reviewed sources are titled "' || t1 || '" and "' || t2 || '".' WHEN 'exaggerated_scope' THEN {_quoted(Y.SCOPE)} WHEN 'missing_evidence' THEN {_quoted(Y.MISSING)}
  WHEN 'unsupported_number' THEN {_quoted(Y.NUMBER)} WHEN 'wrong_attribution' THEN 'The source titled "' || t1 || '" was published as a ' || wrong || ' item.' ELSE {_quoted(Y.BOTH)} END AS three FROM v),
o AS (SELECT *, '## {Y.FIRST_SECTION}' || chr(10) || chr(10) || CASE WHEN listed THEN '1. **' || one || '**' ELSE {_quoted(Y.LEADS[0])} || one END || chr(10) || chr(10) AS opening,
  CASE WHEN listed THEN '2. **' || two || '**' || chr(10) || chr(10) || '3. **' || three || '**' ELSE {_quoted(Y.LEADS[1])} || two || chr(10) || chr(10) || '## {Y.PAIN_SECTION}' || chr(10) || chr(10) || {_quoted(Y.LEADS[2])} || three END AS rest FROM q),
made AS (SELECT *, left(sha256(platform || ':' || idx || ':' || id1 || ':' || id2), 16) AS bundle_id, CASE length_bucket WHEN 'long' THEN {padded("opening", Y.LONG)} || chr(10) || chr(10) || rest WHEN 'medium' THEN {padded("(opening || rest)", Y.MEDIUM)} ELSE opening || rest END
  || chr(10) || chr(10) || '## {Y.LAST_SECTION}' || chr(10) || chr(10) || {_quoted(Y.CLOSING)} || chr(10) AS body FROM o)"""


def _case(values: tuple, k: int) -> str:
    return f"CASE idx % 3 WHEN 0 THEN '{values[0][k]}' WHEN 1 THEN '{values[1][k]}' ELSE '{values[2][k]}' END"


@query(f"WITH {_made_sql()} SELECT bundle_id AS id, platform, CASE WHEN listed THEN 'controlled' ELSE 'naturalistic' END AS stratum, length_bucket, flagged, mutation_type, mutation_type = 'categorical_contradiction' AS internal_contradiction, length(body) AS size, md5(body) AS digest FROM made")
def benchmark_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = Y.reports(Y.pairs(corpus(spark, sf_dir)))
    return made.select("id", "platform", "stratum", "length_bucket", "flagged", "mutation_type", "internal_contradiction", F.length("report_body").cast("long").alias("size"), F.md5("report_body").alias("digest"))


@query(f"""WITH {_made_sql()}, c AS (SELECT bundle_id, body, one AS quote, '{Y.FIRST_SECTION}' AS section, 'supported' AS verdict, 1 AS n_sources FROM made UNION ALL SELECT bundle_id, body, two, '{Y.FIRST_SECTION}', 'supported', 1 FROM made
  UNION ALL SELECT bundle_id, body, three, CASE WHEN listed THEN '{Y.FIRST_SECTION}' ELSE '{Y.PAIN_SECTION}' END, verdict, 2 FROM made), s AS (SELECT *, strpos(body, quote) - 1 AS start FROM c)
  SELECT bundle_id AS id, left(sha256(lower({STRIP(f"regexp_replace(quote, '{WS}+', ' ', 'g')")}) || chr(10) || section || chr(10) || start), 16) AS claim_id, section, start, start + length(quote) AS "end", verdict, verdict IN ('partially', 'contradicted', 'hallucination') AS needs_correction, n_sources, TRUE AS cuts_out FROM s""")
def benchmark_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = Y.claims_of(Y.reports(Y.pairs(corpus(spark, sf_dir))))
    return made.select("id", "claim_id", "section", "start", "end", "verdict", "needs_correction", F.size("source_ids").alias("n_sources"), "cuts_out")


@query("""WITH k AS (SELECT lang, lower(lang) AS word FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
  f AS (SELECT k.lang, doc_id, split_part(text, chr(10), 1) AS title, CAST(row_number() OVER (PARTITION BY k.lang ORDER BY doc_id) AS INTEGER) AS rank FROM k JOIN documents d ON contains(lower(text), word))
  SELECT lang AS query_id, rank, doc_id, '[[02-需求池/' || translate(title, '|[]', '-()') || '|' || translate(title, '|[]', '-()') || ']]' AS link FROM f WHERE rank <= 50""")
def retrieval_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What retrieval gives where no vector answers: pages that hold the query's word, with links to them."""
    d = load(spark, sf_dir, "documents").withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))
    asked = d.where("lang IS NOT NULL").select(F.col("lang").alias("query_id"), F.col("lang").alias("word")).distinct()
    none = spark.createDataFrame([], "query_id string, rank int, key long, score double")
    found = R.with_fallback(none, d, asked, "doc_id", F.col("title"), F.col("text"))
    titles = d.select(F.col("doc_id").alias("key"), "title")
    return found.join(titles, "key").select("query_id", "rank", F.col("key").alias("doc_id"), R.need_link(F.col("title")).alias("link"))


def _experiment(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame, X.Store]:
    made = kept(Y.reports(Y.pairs(corpus(spark, sf_dir))), "reports")
    store = X.Store(spark, f"{shared_dir(spark)}/experiment-{uuid.uuid4().hex}")
    rule = F.transform(C.rule_quotes(F.col("report_body")), lambda q: F.struct(q.alias("quote"), F.lit(Y.FIRST_SECTION).alias("section")))
    return X.verifier_experiment(made, store, M.claims_as_json, M.checks_as_json, M.consistency_by_words, rule), made, store


@query()
def verifier_extraction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each way to extract claims finds those of the benchmark; tested against plain Python."""
    got, made, _ = _experiment(spark, sf_dir)
    return X.extraction_metrics(got["extraction"], made)


@query()
def verifier_evidence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often verdicts are right at each depth of evidence; tested against plain Python."""
    got, made, _ = _experiment(spark, sf_dir)
    return X.evidence_metrics(got["evidence"], got["extraction"], made)


@query()
def verifier_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls asked and shared among the configurations; tested against plain Python."""
    _, made, store = _experiment(spark, sf_dir)
    return X.call_counts(store, made.count())


@query(f"""WITH verdicts AS ({SQL["noise_verdicts"]}), i AS (SELECT d.doc_id, d.source, d.lang, v.verdict FROM documents d JOIN verdicts v USING (doc_id)), new AS (SELECT * FROM i WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)), k AS (SELECT * FROM new WHERE verdict <> 'noise'),
  n AS (SELECT (SELECT count(*) FROM i) AS total, (SELECT count(*) FROM new) AS fresh, (SELECT count(*) FROM k) AS kept, (SELECT count(*) FROM (SELECT DISTINCT source FROM k)) AS platforms, (SELECT count(*) FROM (SELECT DISTINCT source, lang FROM k)) AS entries)
  SELECT phase, name, value FROM n, LATERAL (VALUES ('crawl', 'total', total), ('crawl', 'new', fresh), ('crawl', 'skipped', total - fresh), ('crawl', 'noise', fresh - kept), ('crawl', 'kept', kept), ('extract', 'records', kept), ('extract', 'failed', 0),
    ('report', 'platforms', platforms), ('report', 'needs', kept), ('archive', 'documents', kept), ('distill', 'entries', entries), ('distill', 'sources', kept), ('complete', 'needs', kept)) AS x(phase, name, value)""")
def phase_chain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that a whole run of phases leaves, over all documents; those with labels are known from before."""
    url = F.concat(F.lit("doc/"), F.col("doc_id"))
    d = load(spark, sf_dir, "documents")
    items = d.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("platform"), F.col("lang").alias("topic"), url.alias("source_url"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("content"))
    known = items.join(load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct(), "id").select("platform", "source_url")
    chain = H.Chain(spark, f"{shared_dir(spark)}/chain-{uuid.uuid4().hex}", H.mining_phases(items, known))
    chain.run(1)
    return chain.counts(1)


def contained(asks: list[str]) -> list[str]:
    """A hook: claims that a source holds word for word are supported, others are not verifiable."""
    out = []
    for x in map(json.loads, asks):
        held = [any(c["quote"].lower() in s.lower() for s in x["sources"]) for c in x["claims"]]
        out.append(json.dumps([{"index": c["index"], "verdict": "supported" if h else "unverifiable", "confidence": 1.0 if h else 0.5} for c, h in zip(x["claims"], held, strict=True)]))
    return out


@query("""WITH s AS (SELECT conv_id, coalesce(role, '') AS title, left(coalesce(text, ''), 200) AS content FROM conversations), r AS (SELECT conv_id, title || ' ' || content AS shown, row_number() OVER (PARTITION BY conv_id ORDER BY title, content) AS nth FROM s),
  g AS (SELECT conv_id, list(lower(shown)) AS shown FROM r WHERE nth <= 15 GROUP BY 1), c AS (SELECT conv_id, turn AS claim_id, lower(coalesce(text, '')) AS quote FROM conversations), v AS (SELECT conv_id, claim_id, len(list_filter(shown, lambda x: contains(x, quote))) > 0 AS held FROM c JOIN g USING (conv_id))
  SELECT conv_id, claim_id, CASE WHEN held THEN 'supported' ELSE 'unverifiable' END AS verdict, CAST(CASE WHEN held THEN 1.0 ELSE 0.5 END AS DOUBLE) AS confidence FROM v""")
def batched_claim_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as claims, twelve at a time, against what the conversation's turns begin with."""
    c = load(spark, sf_dir, "conversations")
    claims = c.select("conv_id", F.col("turn").alias("claim_id"), F.col("text").alias("quote"))
    return M.check_in_batches(claims, c.select("conv_id", F.col("role").alias("title"), F.col("text").alias("content")), "conv_id", contained).drop("error")


def records_with_figures(texts: list[str]) -> list[str]:
    """A hook: a discussion with a figure states a need, others do not."""
    return [json.dumps({"title": t.split("\n")[0][:80], "sentiment": "moderate"}) if re.search("[0-9]", t) else "" for t in texts]


@query(f"""WITH verdicts AS ({SQL["noise_verdicts"]}), g AS (SELECT doc_id, CASE WHEN min(quality) = 1 THEN 'yes' ELSE 'no' END AS gold FROM labels GROUP BY 1),
  i AS (SELECT d.doc_id, v.verdict = 'noise' AS noise, regexp_matches(d.text, '[0-9]') AS figure, g.gold FROM documents d JOIN verdicts v USING (doc_id) LEFT JOIN g USING (doc_id)),
  p AS (SELECT 'no_rag' AS configuration, CASE WHEN noise THEN 'no' WHEN figure THEN 'yes' ELSE 'no' END AS present, gold FROM i UNION ALL SELECT 'rag', CASE WHEN noise THEN 'no' WHEN gold IS NULL THEN 'error' WHEN figure THEN 'yes' ELSE 'no' END, gold FROM i),
  r AS (SELECT configuration, present FROM p UNION ALL SELECT 'rag_hitl', CASE WHEN present = 'error' THEN present ELSE gold END FROM p WHERE configuration = 'rag' AND (present = 'error' OR gold IS NOT NULL))
  SELECT configuration, present, count(*) AS n FROM r GROUP BY 1, 2""")
def discussion_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each configuration says of all documents; those with labels have a context, and labels are the gold."""
    items = S.needs(spark, sf_dir).select(F.col("doc_id").alias("id"), "title", F.col("body").alias("content"))
    labelled = load(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("q"))
    contexts = labelled.select("id", F.lit("labelled by a reader").alias("context"))
    gold = labelled.select("id", F.when(F.col("q") == 1, "yes").otherwise("no").alias("present"), *(F.lit("").alias(c) for c in (*X.TEXTS, *X.MOODS)))
    store = X.Store(spark, f"{shared_dir(spark)}/discussions-{uuid.uuid4().hex}")
    got = X.discussion_experiment(items, contexts, gold, store, records_with_figures)
    return got.groupBy("configuration", "present").agg(F.count(F.lit(1)).alias("n"))
