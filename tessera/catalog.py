"""The registered queries of the engine's own operators, each with the SQL that gives the same rows.

The driver's tables stand in for a corpus and a staging store: a document's
lines are chunks of its page, labels say which documents are active, and so on.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats
from .functions import prompts
from .functions.similarity import similarity, too_similar
from .functions.text import checkpoint_number, clean_answer, estimate_tokens, heading_label, normalize, or_default, round_half_even, stable_rank
from .operators import checks, contexts, corpus, evaluation, export, sampling, staging
from .sources.files import read_jsonl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Parameters of the stand-in corpus: least characters of a line, budgets of contexts.
LEAST, ADJACENT, PAGE_TOKENS = 40, 400, formats.PAGE_TOKENS


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- the stand-in corpus ----

def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit("ok").alias("status"))
    rows = read(spark, sf_dir, "documents").join(active, "doc_id", "left")
    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("v1").alias("document_version"), F.col("lang").alias("category"), F.lit(None).cast("string").alias("source_last_updated"), F.sha2("text", 256).alias("source_content_hash"), F.coalesce("status", F.lit("gone")).alias("status"))


def corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("position", "chunk_text"))
    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("v1").alias("document_version"), F.col("lang").alias("category"), F.concat_ws("-", "doc_id", "position").alias("chunk_id"), "position", "chunk_text", F.concat(F.lit('["part", " '), (F.col("position") / 3).cast("int").cast("string"), F.lit('"]')).alias("heading_path"), F.concat(F.lit("Title of "), "source").alias("source_title"), F.lit(None).cast("string").alias("source_url"))


SPACES = r"[\x1c-\x1f\s\x0b\x{85}\p{Z}]"
NORMAL = lambda c: f"lower(trim(regexp_replace({c}, '{SPACES}+', ' ', 'g')))"
STRIPPED = lambda c: f"regexp_replace(regexp_replace({c}, '^{SPACES}+', ''), '{SPACES}+$', '')"
CHUNKS = """chunks AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'v1' AS document_version, lang AS category, source,
  unnest(string_split(text, chr(10))) AS chunk_text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position FROM documents)"""
ELIGIBLE = f"""{CHUNKS}, stripped AS (SELECT * REPLACE ({STRIPPED('chunk_text')} AS chunk_text), doc_id || '-' || position AS chunk_id FROM chunks),
eligible AS (SELECT * FROM stripped WHERE length(chunk_text) >= {LEAST}
  QUALIFY row_number() OVER (PARTITION BY {NORMAL('chunk_text')} ORDER BY doc_id, document_version, position, chunk_id) = 1)"""


def eligible_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.eligible_chunks(corpus_chunks(spark, sf_dir), LEAST)


@query(f"""WITH {CHUNKS} SELECT c.doc_id, c.document_version, c.category, c.doc_id || '-' || position AS chunk_id, CAST(position AS INTEGER) AS position, chunk_text
FROM chunks c JOIN labels l ON l.doc_id = CAST(c.doc_id AS BIGINT) WHERE l.quality = 1""")
def corpus_scan(spark, sf_dir):
    chunks = corpus_chunks(spark, sf_dir).drop("category")
    return corpus.active_chunks(corpus_documents(spark, sf_dir), chunks).select("doc_id", "document_version", "category", "chunk_id", "position", "chunk_text")


@query(f"WITH {ELIGIBLE} SELECT doc_id, document_version, chunk_id, CAST(position AS INTEGER) AS position, chunk_text FROM eligible")
def eligible(spark, sf_dir):
    return eligible_lines(spark, sf_dir).select("doc_id", "document_version", "chunk_id", "position", "chunk_text")


@query(f"""WITH {ELIGIBLE}, near AS (SELECT *, lag(chunk_text) OVER w AS t0, lag(chunk_id) OVER w AS i0, lead(chunk_text) OVER w AS t2, lead(chunk_id) OVER w AS i2
  FROM eligible WINDOW w AS (PARTITION BY doc_id, document_version ORDER BY position, chunk_id)),
a AS (SELECT *, coalesce(length(chunk_text) + length(t0) + 2 <= {ADJACENT}, false) AS b0 FROM near),
b AS (SELECT *, coalesce(length(chunk_text) + CASE WHEN b0 THEN length(t0) + 2 ELSE 0 END + length(t2) + 2 <= {ADJACENT}, false) AS b2 FROM a)
SELECT doc_id || ':' || document_version || ':' || chunk_id AS context_id, concat_ws(' ', CASE WHEN b0 THEN i0 END, chunk_id, CASE WHEN b2 THEN i2 END) AS chunk_ids,
  sha256(concat_ws(chr(10) || chr(10), CASE WHEN b0 THEN t0 END, chunk_text, CASE WHEN b2 THEN t2 END)) AS digest FROM b""")
def adjacent(spark, sf_dir):
    rows = contexts.adjacent_contexts(eligible_lines(spark, sf_dir), ADJACENT)
    return rows.select("context_id", F.array_join("chunk_ids", " ").alias("chunk_ids"), F.sha2("context", 256).alias("digest"))


@query(f"""WITH {ELIGIBLE}, l AS (SELECT *, position - position % 3 AS label FROM eligible),
n AS (SELECT *, CASE WHEN label = lag(label) OVER w THEN 0 ELSE 1 END AS fresh FROM l WINDOW w AS (PARTITION BY doc_id, document_version ORDER BY position, chunk_id))
SELECT chunk_id, CAST(sum(fresh) OVER (PARTITION BY doc_id, document_version ORDER BY position, chunk_id) AS BIGINT) AS section FROM n""")
def sections(spark, sf_dir):
    rows = eligible_lines(spark, sf_dir).withColumn("label", F.col("position") - F.col("position") % 3)
    return contexts.sections(rows).select("chunk_id", F.col("section").cast("long").alias("section"))


# A source is a page here, of more than one window: all eligible lines of its documents, by their place in the document.
PAGES = f"""{ELIGIBLE}, fit AS (SELECT * REPLACE (source AS doc_id), 'PAGE TITLE: Title of ' || source || chr(10) || chr(10) AS title, 'part > ' || CAST(position // 3 AS VARCHAR) AS label FROM eligible),
rendered AS (SELECT *, 'SECTION: ' || label || chr(10) || chunk_text AS body, row_number() OVER w AS k FROM fit WINDOW w AS (PARTITION BY doc_id ORDER BY position, chunk_id)),
marked AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY doc_id ORDER BY k) THEN 0 ELSE 1 END AS starts, length(title) + sum(length(body)) OVER (PARTITION BY doc_id) + 2 * (count(*) OVER (PARTITION BY doc_id) - 1) AS page_chars FROM rendered),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY k) AS section FROM marked),
sized AS (SELECT *, sum(length(body)) OVER s + 2 * (count(*) OVER s - 1) AS section_chars FROM numbered WINDOW s AS (PARTITION BY doc_id, section)),
walk(doc_id, k, w, used) AS (
  SELECT doc_id, k, CASE WHEN page_chars <= {4 * PAGE_TOKENS} THEN 0 ELSE 1 END, length(body) FROM sized WHERE k = 1
  UNION ALL SELECT s.doc_id, s.k, CASE WHEN x.w = 0 THEN 0 WHEN x.opens THEN x.w + 1 ELSE x.w END, CASE WHEN x.w > 0 AND x.opens THEN length(s.body) ELSE x.used + 2 + length(s.body) END
  FROM (SELECT p.doc_id, p.k, p.w, p.used, (n.starts = 1 OR length(n.title) + n.section_chars > {4 * PAGE_TOKENS}) AND length(n.title) + p.used + 2 + CASE WHEN n.starts = 1 THEN n.section_chars ELSE length(n.body) END > {4 * PAGE_TOKENS} AS opens
    FROM walk p JOIN sized n ON n.doc_id = p.doc_id AND n.k = p.k + 1) x JOIN sized s ON s.doc_id = x.doc_id AND s.k = x.k + 1),
windows AS (SELECT s.doc_id, w, any_value(title) || string_agg(body, chr(10) || chr(10) ORDER BY s.k) AS context, string_agg(chunk_id, ' ' ORDER BY s.k) AS chunk_ids FROM sized s JOIN walk USING (doc_id, k) GROUP BY s.doc_id, w)"""


def page_windows_of(spark, sf_dir):
    rows = eligible_lines(spark, sf_dir).withColumn("doc_id", F.replace("source_title", F.lit("Title of ")))
    return contexts.page_contexts(rows, PAGE_TOKENS)


@query(f"""WITH RECURSIVE {PAGES} SELECT doc_id || ':v1:page-aware-v2' || CASE WHEN w > 0 THEN format(':window-{{:03d}}', w) ELSE '' END AS context_id, CASE WHEN w > 0 THEN 'page_window' ELSE 'full_page' END AS context_kind,
  CAST(greatest(w, 1) AS INTEGER) AS window_index, chunk_ids, CAST(ceil(length(context) / 4.0) AS INTEGER) AS estimated_context_tokens, sha256(context) AS digest FROM windows""")
def page_windows(spark, sf_dir):
    rows = page_windows_of(spark, sf_dir)
    return rows.select("context_id", "context_kind", "window_index", F.array_join("chunk_ids", " ").alias("chunk_ids"), "estimated_context_tokens", F.sha2("context", 256).alias("digest"))


@query(f"""WITH RECURSIVE {PAGES} SELECT count(*) FILTER (w = 0) AS full_pages, count(*) FILTER (w > 0) AS page_windows, count(DISTINCT doc_id) FILTER (w > 0) AS windowed_pages, CAST(max(ceil(length(context) / 4.0)) AS INTEGER) AS largest_estimate FROM windows""")
def context_summary(spark, sf_dir):
    return contexts.context_summary(page_windows_of(spark, sf_dir))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS INTEGER) AS tokens FROM documents")
def token_est(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, {NORMAL('text')} AS normal, sha256({NORMAL('text')}) AS rank FROM documents")
def normalized(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", normalize(F.col("text")).alias("normal")).withColumn("rank", stable_rank(F.col("normal")))


@query("""SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'Page content' WHEN 1 THEN 'Setup' WHEN 2 THEN 'Setup > Disks' WHEN 3 THEN 'Page content' WHEN 4 THEN 'Limits' WHEN 5 THEN 'A > 1 > None > True' ELSE '[broken' END AS label FROM pages""")
def heading_labels(spark, sf_dir):
    paths = ["  ", "Setup ", '["Setup", " ", " Disks "]', "[]", '"Limits"', '["A", 1, null, true]', "[broken"]
    chosen = F.element_at(F.array(*map(F.lit, paths)), (F.col("page_id") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", heading_label(chosen).alias("label"))


@query(f"WITH {CHUNKS} SELECT count(DISTINCT c.doc_id) AS document_count, count(*) AS chunk_count FROM chunks c JOIN labels l ON l.doc_id = CAST(c.doc_id AS BIGINT) WHERE l.quality = 1")
def manifest(spark, sf_dir):
    rows = corpus.active_chunks(corpus_documents(spark, sf_dir), corpus_chunks(spark, sf_dir).drop("category"))
    return corpus.source_manifest(rows).select("document_count", "chunk_count")


@query(f"""WITH {CHUNKS}, part AS (SELECT c.doc_id, sha256('{{"doc_id":"' || c.doc_id || '","document_version":"v1","chunk_id":"' || c.doc_id || '-' || position || '","source_content_hash":"' || sha256(d.text) || '"}}') AS digest, position
  FROM chunks c JOIN labels l ON l.doc_id = CAST(c.doc_id AS BIGINT) JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 1),
page AS (SELECT doc_id, sha256(string_agg(digest, '' ORDER BY position)) AS digest, count(*) AS chunks FROM part GROUP BY doc_id),
folded AS (SELECT substr(sha256(doc_id || ':v1'), 1, 3) AS range, sha256(string_agg(digest, '' ORDER BY doc_id)) AS digest, count(*) AS documents, sum(chunks) AS chunks FROM page GROUP BY 1)
SELECT CAST(sum(documents) AS BIGINT) AS document_count, CAST(sum(chunks) AS BIGINT) AS chunk_count, sha256(string_agg(digest, '' ORDER BY range)) AS manifest_sha256 FROM folded""")
def manifest_digest(spark, sf_dir):
    """The same with its digest."""
    return corpus.source_manifest(corpus.active_chunks(corpus_documents(spark, sf_dir), corpus_chunks(spark, sf_dir).drop("category")))


# ---- selection ----

@query("""WITH one AS (SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) = 1),
turn AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256(lang || ':' || source)) AS r FROM one)
SELECT doc_id, lang AS category, row_number() OVER (ORDER BY r, lang) - 1 AS selection_index FROM turn QUALIFY row_number() OVER (ORDER BY r, lang) <= 40""")
def balanced(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), F.concat_ws(":", "lang", "source").alias("source_page_id"), F.col("doc_id").cast("string").alias("training_example_id"))
    return sampling.benchmark_selection(rows, 40).select("doc_id", "category", F.col("selection_index").cast("long").alias("selection_index"))


@query("""WITH turn AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS r FROM documents)
SELECT doc_id, lang AS category, row_number() OVER (ORDER BY r, lang) - 1 AS selection_index FROM turn QUALIFY row_number() OVER (ORDER BY r, lang) <= 50""")
def selection(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), F.col("doc_id").cast("string").alias("training_example_id"))
    return sampling.checkpoint_selection(rows, 50).select("doc_id", "category", F.col("selection_index").cast("long").alias("selection_index"))


@query("SELECT doc_id FROM documents ORDER BY sha256('17:' || doc_id), doc_id LIMIT 64")
def seeded(spark, sf_dir):
    return sampling.seeded_subset(read(spark, sf_dir, "documents").select("doc_id"), 64, 17, "doc_id")


#: All turns of a conversation in order; n of them, the first two by name.
TURNS = """t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations),
p AS (SELECT conv_id, count(*) AS n, max(role) FILTER (k = 1) AS r0, max(text) FILTER (k = 1) AS t0, max(role) FILTER (k = 2) AS r1, max(text) FILTER (k = 2) AS t1 FROM t GROUP BY conv_id)"""


def conversations_messages(spark, sf_dir):
    turn = F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("message"))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return rows.select("conv_id", F.col("turns.message").alias("messages"))


@query(f"""WITH {TURNS}
SELECT conv_id, coalesce(n = 2 AND r0 = 'user' AND r1 = 'assistant' AND {STRIPPED('t0')} <> '' AND {STRIPPED('t1')} <> '', false) AS valid FROM p""")
def messages(spark, sf_dir):
    return conversations_messages(spark, sf_dir).select("conv_id", checks.valid_messages().alias("valid"))


@query(f"""WITH {TURNS}
SELECT t0 AS prompt, t1 AS completion FROM p WHERE n = 2 AND r0 = 'user' AND r1 = 'assistant' AND trim(t0) <> '' AND trim(t1) <> ''""")
def prompt_completion(spark, sf_dir):
    rows = export.prompt_completion(conversations_messages(spark, sf_dir))
    return rows.select(F.col("prompt")[0]["content"].alias("prompt"), F.col("completion")[0]["content"].alias("completion"))


# ---- staging ----

@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def status_hist(spark, sf_dir):
    return staging.status_histogram(read(spark, sf_dir, "events"), "event_type")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS context_id FROM orders o WHERE o_orderstatus = 'P' OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 10""")
def pilot(spark, sf_dir):
    waiting = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("context_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("complete").alias("question_status"))
    asked = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("context_id"), F.when(F.col("l_returnflag") == "R", "pending").otherwise("complete").alias("answer_status"))
    return staging.pilot_scope(waiting, asked, 10)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events ORDER BY event_id DESC LIMIT 3")
def recent(spark, sf_dir):
    rows = read(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(3)
    return rows.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending(spark, sf_dir):
    return staging.todo(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def scoped(spark, sf_dir):
    return staging.in_scope(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query("SELECT count(*) AS missing FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en'))")
def fk(spark, sf_dir):
    missing = checks.missing_keys(read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id")
    return missing.agg(F.count("*").alias("missing"))


@query("""WITH old AS (SELECT o_orderkey, 'old' AS origin FROM orders WHERE o_orderkey % 3 = 0), new AS (SELECT o_orderkey, 'new' AS origin FROM orders WHERE o_orderkey % 5 = 0)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)""")
def insert_if_absent(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    old = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("old").alias("origin"))
    new = orders.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("new").alias("origin"))
    return old.unionByName(staging.insert_if_absent(old, new.unionByName(new), ["o_orderkey"]))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def upsert(spark, sf_dir):
    old = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return staging.upsert(old, old.where("o_orderkey % 7 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def upsert_log(spark, sf_dir):
    first = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("seq"))
    second = first.where("o_orderkey % 7 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(2).alias("seq"))
    return staging.latest(first.unionByName(second), ["o_orderkey"]).drop("seq")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def status_latest(spark, sf_dir):
    return staging.latest_status(read(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("SELECT count(*) FILTER (o_orderstatus = 'P') AS pending_contexts, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS pending_answers FROM orders")
def pending_counts(spark, sf_dir):
    flag = lambda c, v: F.when(F.col(c) == v, "pending").otherwise("complete")
    return checks.pending_counts(read(spark, sf_dir, "orders").select(flag("o_orderstatus", "P").alias("question_status")), read(spark, sf_dir, "lineitem").select(flag("l_returnflag", "R").alias("answer_status")))


def scratch(spark: SparkSession) -> str:
    """A new place in the cluster's shared folder; a local one only where none is named and the session is local, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/catalog-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def new_store(spark: SparkSession) -> staging.Store:
    store = staging.Store(spark, scratch(spark))
    store.create()
    return store


def stored_contexts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("context_id"), F.col("lang").alias("payload"))


@query("SELECT CAST(doc_id AS VARCHAR) AS context_id, lang AS payload, CASE doc_id % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'error:x' ELSE 'pending' END AS question_status FROM documents")
def store_mark(spark, sf_dir):
    """A store's contexts after an insert, a replay of it, and new statuses of some."""
    store, rows = new_store(spark), stored_contexts(spark, sf_dir)
    store.insert("contexts", rows)
    store.insert("contexts", rows.withColumn("payload", F.lit("again")))
    key = F.col("context_id").cast("long") % 4
    store.mark("contexts", rows.where(key < 2).select("context_id", F.when(key == 0, "complete").otherwise("error:x").alias("question_status")))
    return store.table("contexts")


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS context_id, event_type AS question, 'pending' AS answer_status FROM events")
def store_insert(spark, sf_dir):
    """Questions by context and wording: what is asked again isn't added."""
    store = new_store(spark)
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("context_id"), F.col("event_type").alias("question"), F.lit(None).cast("string").alias("payload"))
    store.insert("questions", rows.where("question < 'm'"), ["context_id", "question"])
    store.insert("questions", rows, ["context_id", "question"])
    return store.table("questions").select("context_id", "question", "answer_status")


@query("SELECT doc_id AS question_id, lang AS payload, CAST(doc_id % 3 <> 0 AS INTEGER) AS accepted, CASE WHEN doc_id % 3 = 0 THEN 'short' END AS rejection_reason FROM documents")
def store_put(spark, sf_dir):
    """Examples, some replaced later."""
    store = new_store(spark)
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.col("lang").alias("payload"))
    store.put("examples", rows.select("*", F.lit(1).alias("accepted"), F.lit(None).cast("string").alias("rejection_reason")))
    store.put("examples", rows.where("question_id % 3 = 0").select("*", F.lit(0).alias("accepted"), F.lit("short").alias("rejection_reason")))
    return store.table("examples")


@query("SELECT CAST(doc_id AS VARCHAR) AS training_example_id, lang AS category, 'pending' AS evaluation_status FROM documents WHERE lang = 'en'")
def store_freeze(spark, sf_dir):
    """A selection that was frozen stays, whatever is offered later."""
    store = new_store(spark)
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("training_example_id"), F.col("lang").alias("category"), F.lit("{}").alias("payload"))
    store.freeze("evaluation_candidates", rows.where("category = 'en'"))
    return store.freeze("evaluation_candidates", rows.where("category = 'de'")).select("training_example_id", "category", "evaluation_status")


@query("SELECT quality AS accepted, count(*) AS n FROM labels GROUP BY quality ORDER BY quality DESC")
def accepted_counts(spark, sf_dir):
    return staging.key_histogram(read(spark, sf_dir, "labels").select(F.col("quality").alias("accepted")), "accepted")


@query("SELECT count(*) AS total, count(l.doc_id) AS done, count(*) - count(l.doc_id) AS remaining FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def progress(spark, sf_dir):
    return staging.progress(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicates(spark, sf_dir):
    """Keys that a check of uniqueness finds more than once."""
    return checks.duplicates(read(spark, sf_dir, "documents"), ["text"])


# ---- benchmark and export ----

@query(ORACLES["balanced"])
def checked_benchmark(spark, sf_dir):
    """The balanced selection once it has passed the checks: its size, unique ids and pages, all of them training rows."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), F.concat_ws(":", "lang", "source").alias("source_page_id"), F.col("doc_id").cast("string").alias("training_example_id"))
    chosen = sampling.benchmark_selection(rows, 40)
    checked = checks.require_benchmark(chosen, rows, chosen.count())
    return checked.select("doc_id", "category", F.col("selection_index").cast("long").alias("selection_index"))


@query("SELECT count(*) AS saved FROM nation WHERE n_nationkey < 10")
def resumed(spark, sf_dir):
    """How many saved answers a run resumes after: they have to be the benchmark's first ones."""
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("benchmark_index"), F.col("n_name").alias("question"))
    return spark.range(1).select(F.lit(checks.require_prefix(rows.where("benchmark_index < 10"), rows)).cast("long").alias("saved"))


@query("SELECT doc_id, text, lang FROM documents")
def jsonl_round_trip(spark, sf_dir):
    """Documents written as one JSONL file that must not exist, and read again."""
    path = f"{scratch(spark)}/documents.jsonl"
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    export.write_jsonl(rows, path, order=["doc_id"])
    return read_jsonl(spark, path, rows.schema)


@query("""SELECT count(*) AS n, sha256(string_agg('{"doc_id":' || doc_id || '}' || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents""")
def file_digest(spark, sf_dir):
    """Lines and digest of an exported file, checked against each other as a manifest does."""
    path = f"{scratch(spark)}/ids.jsonl"
    export.write_jsonl(read(spark, sf_dir, "documents").select("doc_id"), path, order=["doc_id"])
    found = export.file_metadata(spark, path)
    export.verify_files(spark, {path: found["sha256"]})
    return spark.range(1).select(F.lit(found["rows"]).cast("long").alias("n"), F.lit(found["sha256"]).alias("sha256"))


def examples_of(spark, sf_dir):
    """Conversations as examples, their ids as questions, documents as contexts."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), "lang")
    context = F.struct(F.col("conv_id").cast("string").alias("doc_id"), F.lit("v1").alias("document_version"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("category"), F.lit(None).cast("string").alias("source_title"), F.lit("u").alias("source_url"), F.concat_ws(":", F.col("conv_id").cast("string"), F.lit("v1")).alias("context_id"))
    evidence = F.when(F.col("conv_id") % 4 == 0, F.array(F.lit("  "))).otherwise(F.array(F.lit(" quoted ")))
    payload = F.struct(F.struct("messages").alias("example"), F.struct(context.alias("context"), evidence.alias("evidence")).alias("provenance"))
    rows = conversations_messages(spark, sf_dir).join(docs, "conv_id")
    return rows.select(F.col("conv_id").alias("question_id"), payload.alias("payload"), (F.col("conv_id") % 3 != 0).cast("int").alias("accepted"))


def questions_of(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question_id")).distinct()
    return rows.withColumn("answer_status", F.when(F.col("question_id") % 5 == 0, "error:x").otherwise("complete"))


CANDIDATES = f"""WITH {TURNS}
SELECT 'db:' || conv_id AS training_example_id, conv_id || ':v1' AS source_page_id, CASE lang WHEN 'en' THEN 'uncategorized' ELSE lang END AS category, {STRIPPED('t0')} AS training_question, {STRIPPED('t1')} AS training_answer, 'quoted' AS evidence, '' AS source_title
FROM p JOIN documents d ON d.doc_id = conv_id WHERE n = 2 AND conv_id % 3 <> 0 AND conv_id % 4 <> 0 AND conv_id % 5 <> 0"""


@query(CANDIDATES)
def candidates(spark, sf_dir):
    rows = sampling.candidates(examples_of(spark, sf_dir), questions_of(spark, sf_dir), "db")
    return rows.select("training_example_id", "source_page_id", "category", "training_question", "training_answer", F.array_join("evidence", "|").alias("evidence"), "source_title")


@query(f"""WITH {TURNS} SELECT 'db:' || conv_id AS training_example_id, 'independent' AS dataset_kind, n AS turns, t0 AS question, 'db:' || conv_id AS named FROM p JOIN documents d ON d.doc_id = conv_id
UNION ALL SELECT 'page:' || conv_id, 'page_aware', n, t0, 'page:' || conv_id FROM p JOIN documents d ON d.doc_id = conv_id""")
def training_rows(spark, sf_dir):
    rows = examples_of(spark, sf_dir)
    both = export.training_rows(rows, "independent", "db").unionByName(export.training_rows(rows, "page_aware", "page"))
    return both.select("training_example_id", "dataset_kind", F.size("example.messages").cast("long").alias("turns"), F.col("example.messages")[0]["content"].alias("question"), F.col("provenance.training_example_id").alias("named"))


@query(f"""WITH saved AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' edited' ELSE replace(text, ' ', '  ') END AS context FROM documents), current AS (SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0)
SELECT s.doc_id, coalesce({NORMAL('s.context')} = {NORMAL('c.text')}, false) AS kept FROM saved s LEFT JOIN current c USING (doc_id)""")
def revalidate(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    saved = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.replace("text", F.lit(" "), F.lit("  "))).alias("context"))
    current = docs.where("doc_id % 7 <> 0").select("doc_id", F.col("text").alias("context"))
    return export.revalidated(saved, current, key="doc_id").select("doc_id", "kept")


@query()
def similar(spark, sf_dir):
    """Each user's turn, whole, against itself with other words at the end: an order-dependent ratio without SQL counterpart."""
    rows = read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("training"), F.concat("text", F.lit(" other words")).alias("evaluation"))
    return rows.select("conv_id", "turn", F.round(similarity(F.col("training"), F.col("evaluation")), 6).alias("ratio"), too_similar(F.col("training"), F.col("evaluation")).alias("too_similar"))


PART = lambda name, value: f"'{name}:' || chr(10) || {value}"
ASKED = lambda *parts: " || chr(10) || chr(10) || ".join(PART(n, v) for n, v in parts)


@query(f"""SELECT page_id, 'system user' AS roles, {ASKED(('CONTEXT', 'html'))} AS adjacent, {ASKED(('PAGE CONTEXT', 'html'))} AS page, {ASKED(('QUESTION', 'url'), ('CONTEXT', 'html'))} AS answer,
  {ASKED(('SOURCE TITLE', 'url'), ('TRAINING QUESTION', 'html'), ('TRAINING ANSWER', 'url'), ('EVIDENCE', "'- ' || url || chr(10) || chr(10) || '- ' || html"))} AS evaluation, {ASKED(('QUESTION', 'url'), ('REFERENCE', 'html'), ('CANDIDATE', 'url'))} AS judge FROM pages""")
def prompts_of_pages(spark, sf_dir):
    """What each of the five prompts asks of a page."""
    url, html = F.col("url"), F.col("html")
    made = {"adjacent": prompts.question_messages(html), "page": prompts.page_question_messages(html), "answer": prompts.answer_messages(url, html), "evaluation": prompts.evaluation_messages(url, html, url, F.array(url, html)), "judge": prompts.judge_messages(url, html, url)}
    roles = F.array_join(F.array_distinct(F.flatten(F.array(*(F.transform(m, lambda x: x["role"]) for m in made.values())))), " ")
    return read(spark, sf_dir, "pages").select("page_id", roles.alias("roles"), *(m[1]["content"].alias(name) for name, m in made.items()))


@query("SELECT candidate, benchmark_index, coalesce(c BETWEEN 1 AND 5 AND d BETWEEN 1 AND 5 AND u >= 0, false) AS valid FROM (SELECT event_type AS candidate, event_id AS benchmark_index, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, k % 7 AS c, k % 5 + 1 AS d, k % 4 - 1 AS u FROM events)")
def judgements(spark, sf_dir):
    """Which judgements are within their scales; some are made not to be."""
    k = F.get_json_object("props", "$.k").cast("int")
    judge = F.struct((k % 7).alias("correctness"), (k % 5 + 1).alias("completeness"), (k % 4 - 1).alias("unsupported_claims"), F.lit("").alias("rationale"))
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("candidate"), F.col("event_id").alias("benchmark_index"), judge.alias("judge"))
    return rows.select("candidate", "benchmark_index", checks.valid_judgement().alias("valid"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS context_id FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey")
def pending_in_order(spark, sf_dir):
    """Pending rows in the order of their insertion."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "pending").otherwise("complete").alias("question_status"))
    return staging.pending(rows, "question_status", "o_orderkey").select(F.col("o_orderkey").cast("string").alias("context_id"))


# ---- evaluation ----

SCORES = """scores AS (SELECT event_type AS candidate, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events),
means AS (SELECT candidate, avg(k % 5 + 1) AS c, avg(k % 3 + 1) AS d, CAST(sum(k % 2) AS BIGINT) AS u, avg(value) AS l FROM scores GROUP BY candidate)"""


def scores_of(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    judge = F.struct((k % 5 + 1).alias("correctness"), (k % 3 + 1).alias("completeness"), (k % 2).alias("unsupported_claims"), F.lit("").alias("rationale"))
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("candidate"), F.col("event_id").alias("benchmark_index"), F.col("value").alias("latency_ms"), judge.alias("judge"))


@query(f"""WITH {SCORES} SELECT candidate, round(c, 6) AS correctness_mean, round(d, 6) AS completeness_mean, u AS unsupported_claims_total, round(l, 6) AS latency_ms_mean, CAST(row_number() OVER (ORDER BY c DESC, d DESC, u, l, candidate) AS INTEGER) AS rank FROM means""")
def metrics_rank(spark, sf_dir):
    rows = evaluation.ranking(evaluation.metrics(scores_of(spark, sf_dir)))
    means = ("correctness_mean", "completeness_mean", "latency_ms_mean")
    return rows.withColumns({c: F.round(c, 6) for c in means})


@query(f"WITH {SCORES} SELECT candidate, CASE candidate WHEN 'rag' THEN 'retrieval' WHEN 'base' THEN 'base' ELSE 'adapter' END AS source FROM means ORDER BY c DESC, d DESC, u, l, candidate LIMIT 1")
def best(spark, sf_dir):
    rows = evaluation.winner(evaluation.metrics(scores_of(spark, sf_dir)))
    return rows.select("candidate", evaluation.source_tag().alias("source"))


@query(f"WITH {SCORES} SELECT s.candidate, count(*) AS n, min(m.u) AS unsupported FROM scores s JOIN means m USING (candidate) GROUP BY s.candidate")
def reports(spark, sf_dir):
    return evaluation.report(scores_of(spark, sf_dir)).select("candidate", F.size("rows").cast("long").alias("n"), F.col("metrics.unsupported_claims_total").alias("unsupported"))


@query("SELECT 'checkpoint-' || max(p_size) AS checkpoint, max(p_size) AS step FROM part")
def last_checkpoint(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.concat(F.lit("checkpoint-"), "p_size").alias("path"))
    step = checkpoint_number(F.col("path"))
    return rows.agg(F.max_by("path", step).alias("checkpoint"), F.max(step).alias("step"))


@query(f"SELECT conv_id, turn, {STRIPPED('text')} AS answer FROM conversations")
def cleaned_answers(spark, sf_dir):
    raw = F.concat(F.col("text"), F.lit("<|im_end|>\n<|im_start|>user\nand then?"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", clean_answer(raw).alias("answer"))


@query("SELECT event_id, CAST(round_even(value, 0) AS BIGINT) AS ms FROM events")
def latencies(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", round_half_even(F.col("value")).alias("ms"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'none' WHEN doc_id % 3 = 1 THEN 'none' ELSE lang END AS strict, CASE WHEN doc_id % 3 = 0 THEN 'none' WHEN doc_id % 3 = 1 THEN '' ELSE lang END AS loose FROM documents")
def defaults(spark, sf_dir):
    value = F.when(F.col("doc_id") % 3 == 1, "").when(F.col("doc_id") % 3 == 2, F.col("lang"))
    return read(spark, sf_dir, "documents").select("doc_id", or_default(value, "none").alias("strict"), or_default(value, "none", empty_too=False).alias("loose"))
