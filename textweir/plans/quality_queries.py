"""Queries on scores, routing, jobs, the factorial benchmark and media."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources.views import Source
from .registry import query

_SCORES = "SELECT l.doc_id, (l.doc_id % 10) / 10.0::DOUBLE AS draft, (l.doc_id % 7) / 10.0::DOUBLE + 0.2::DOUBLE * quality AS revised, ['高', '中', '低'][l.doc_id % 3 + 1] AS tier, d.source AS job, CASE WHEN l.doc_id % 4 = 0 THEN 'f' || l.doc_id ELSE '' END AS feedback FROM labels l JOIN documents d USING (doc_id)"


def _scores(src: Source) -> DataFrame:
    i = F.col("doc_id")
    return src.table("labels").join(src.table("documents").select("doc_id", F.col("source").alias("job")), "doc_id").select(
        "doc_id", ((i % 10) / 10.0).alias("draft"), ((i % 7) / 10.0 + F.lit(0.2) * F.col("quality")).alias("revised"),
        F.element_at(F.array(*[F.lit(t) for t in Q.TIERS]), (i % 3 + 1).cast("int")).alias("tier"), "job", i.alias("block"),
        F.when(i % 4 == 0, F.concat(F.lit("f"), i.cast("string"))).otherwise("").alias("feedback"),
    )


@query(f"SELECT doc_id, revised > draft AS adopted, round(CASE WHEN revised > draft THEN revised ELSE draft END, 6) AS final FROM ({_SCORES}) s")
def qe_adoption(src: Source) -> DataFrame:
    better = Q.adopt(F.col("draft"), F.col("revised"))
    return _scores(src).select("doc_id", better.alias("adopted"), F.round(F.when(better, F.col("revised")).otherwise(F.col("draft")), 6).alias("final"))


@query(f"SELECT job, round(avg(draft), 6) AS mean, count(*) AS n FROM ({_SCORES}) s GROUP BY job")
def qe_job_mean(src: Source) -> DataFrame:
    return _scores(src).groupBy("job").agg(F.round(F.avg("draft"), 6).alias("mean"), F.count("*").alias("n"))


@query(f"SELECT job, arg_min(tier, CASE tier WHEN '低' THEN 1 WHEN '中' THEN 2 ELSE 3 END) AS tier, round(avg(CASE tier WHEN '高' THEN 1.0 WHEN '中' THEN 0.5 ELSE 0.0 END), 6) AS mean, coalesce(string_agg(feedback, '; ' ORDER BY doc_id) FILTER (WHERE feedback <> ''), '') AS feedback FROM ({_SCORES}) s GROUP BY job")
def judge_worst_tier(src: Source) -> DataFrame:
    return Q.worst_tier(_scores(src), "job").withColumn("mean", F.round("mean", 6))


_REPLY = "CASE doc_id % 5 WHEN 0 THEN concat('{\"score\": \"', tier, '\"}') WHEN 1 THEN concat('I say {\"score\": \"', tier, '\"} so') WHEN 2 THEN concat('{\"score\": \"9\"} but ', tier) WHEN 3 THEN concat('低 or ', tier) ELSE 'none' END"


@query(f"SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1) THEN tier WHEN doc_id % 5 = 2 THEN tier WHEN doc_id % 5 = 3 THEN (CASE WHEN tier IN ('高', '中') THEN tier ELSE '低' END) END AS tier FROM ({_SCORES}) s")
def judge_reply_parse(src: Source) -> DataFrame:
    return _scores(src).select("doc_id", Q.judge_tier(F.expr(_REPLY)).alias("tier"))


_KEYWORDS = [
    ("technical_process", ["process", "machine", "ering", "ation"]),
    ("business_finance", ["invoice", "heit", "keit", "ung"]),
    ("legal_contract", ["shall", "mente", "ción"]),
    ("marketing_pr", ["campaign", "eau", "eux", "elle"]),
    ("daily_communication", ["hello", "thing"]),
]


@query(
    "WITH k(scenario, ord, words) AS (VALUES " + ", ".join(f"('{s}', {i}, {w})" for i, (s, w) in enumerate(_KEYWORDS)) + """), s AS (SELECT doc_id, scenario, ord, len(list_filter(words, lambda w: contains(lower(text), w))) AS n FROM documents, k)
    SELECT doc_id, CASE WHEN n >= 2 THEN scenario ELSE 'general' END AS scenario, CAST(n AS BIGINT) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ord) AS r FROM s) t WHERE r = 1"""
)
def scenario_detect(src: Source) -> DataFrame:
    words = src.spark.createDataFrame([(s, i, w) for i, (s, w) in enumerate(_KEYWORDS)], "scenario string, ord int, words array<string>")
    return Q.scenario(src.table("documents"), words, "doc_id", "text")


@query("SELECT r_name AS model, CASE WHEN n_nationkey % 4 = 0 THEN 'default' ELSE r_name END AS provider, min(n_nationkey) AS first, string_agg(n_name, ',' ORDER BY n_nationkey) AS targets FROM (SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 4 = 0 THEN 'base' ELSE r_name END AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey) t GROUP BY ALL")
def route_groups(src: Source) -> DataFrame:
    n = src.table("nation").join(src.table("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    rules = n.select(F.col("n_name").alias("target"), F.col("r_name").alias("model"), F.when(F.col("n_nationkey") % 4 != 0, F.col("r_name")).alias("provider"))
    return Q.route_groups(Q.route(n.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("target")), rules, ("base", "default")))


@query("WITH p AS (SELECT r_name AS provider FROM region WHERE r_regionkey % 2 = 0), c AS (SELECT n_name, i, (SELECT r_name FROM region WHERE r_regionkey = (n_nationkey + i) % 5) AS provider FROM nation, (VALUES (0), (1), (2)) AS v(i)) SELECT n_name, arg_min(provider, i) AS provider FROM c WHERE provider IN (SELECT provider FROM p) GROUP BY n_name")
def route_first_healthy(src: Source) -> DataFrame:
    names = src.table("region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("r"))
    chains = src.table("nation").crossJoin(F.broadcast(names)).select("n_name", F.array(*[F.element_at("r", ((F.col("n_nationkey") + i) % 5 + 1).cast("int"))["r_name"] for i in range(3)]).alias("chain"))  # one row
    health = src.table("region").select(F.col("r_name").alias("provider"), F.lit(True).alias("enabled"), (F.col("r_regionkey") % 2 == 0).alias("healthy"))
    return Q.first_healthy(chains, health, "n_name")


_FILES = "SELECT p_partkey, 'f' || p_partkey AS stem, ['.docx', '.PDF', '.xls', '.ppt', '.xlsx', '.doc'][p_partkey % 6 + 1] AS ext, ['append', 'bilingual', 'adjacent', 'annotation'][p_size % 4 + 1] AS mode, p_size % 2 = 0 AS as_pdf, CASE WHEN p_size % 3 = 0 THEN 'vi' ELSE '' END AS suffix FROM part"


def _files(src: Source) -> DataFrame:
    pick = lambda xs, c, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col(c) % n + 1).cast("int"))
    return src.table("part").select("p_partkey", F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("stem"), pick([".docx", ".PDF", ".xls", ".ppt", ".xlsx", ".doc"], "p_partkey", 6).alias("ext"), pick(["append", "bilingual", "adjacent", "annotation"], "p_size", 4).alias("mode"), (F.col("p_size") % 2 == 0).alias("as_pdf"), F.when(F.col("p_size") % 3 == 0, "vi").otherwise("").alias("suffix"))


@query(f"SELECT p_partkey, CASE WHEN mode = 'bilingual' AND lower(ext) NOT IN ('.docx', '.doc') THEN 'append' WHEN mode IN ('adjacent', 'annotation') AND lower(ext) NOT IN ('.xlsx', '.xls') THEN 'append' ELSE mode END AS mode FROM ({_FILES}) f")
def output_mode_degrade(src: Source) -> DataFrame:
    return _files(src).select("p_partkey", Q.degrade_mode(F.col("mode"), F.lower("ext")).alias("mode"))


@query(f"SELECT p_partkey, concat(stem, '_translated', CASE WHEN suffix = '' THEN '' ELSE '_' || suffix END, CASE lower(ext) WHEN '.pdf' THEN (CASE WHEN as_pdf THEN '.pdf' ELSE '.docx' END) WHEN '.doc' THEN '.docx' WHEN '.ppt' THEN '.pptx' WHEN '.xls' THEN '.xlsx' ELSE lower(ext) END) AS name FROM ({_FILES}) f")
def output_name(src: Source) -> DataFrame:
    return _files(src).select("p_partkey", Q.output_name(F.col("stem"), F.col("ext"), F.col("as_pdf"), F.col("suffix")).alias("name"))


_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END"


def _jobs(src: Source) -> DataFrame:
    return src.table("orders").select(F.col("o_orderkey").alias("job_id"), F.expr(_STATUS).alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("owner"), "o_totalprice")


@query(f"SELECT count(*) FILTER (WHERE s = 'running') AS running, count(*) FILTER (WHERE s = 'completed') AS completed, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) AS total FROM (SELECT {_STATUS} AS s FROM orders) o")
def job_status_counts(src: Source) -> DataFrame:
    return _jobs(src).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("running", "completed", "failed")], F.count("*").alias("total"))


@query(f"WITH j AS (SELECT o_orderkey AS job_id, {_STATUS} AS status, o_orderdate, o_custkey AS owner FROM orders), r AS (SELECT *, count(*) OVER (PARTITION BY owner) AS a, row_number() OVER (PARTITION BY owner, status IN ('completed', 'failed') ORDER BY o_orderdate, job_id) AS n FROM j) SELECT job_id, owner, status FROM r WHERE NOT (status IN ('completed', 'failed') AND n <= a - 8 + 1)")
def job_capacity_evict(src: Source) -> DataFrame:
    return Q.evict(_jobs(src), 8, "owner").select("job_id", "owner", "status")


@query(f"SELECT o_orderkey AS job_id FROM orders WHERE NOT ({_STATUS} IN ('completed', 'failed') AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 24 HOURS)")
def job_expire(src: Source) -> DataFrame:
    return Q.expire(_jobs(src), F.lit("1998-01-01").cast("timestamp")).select("job_id")


@query("""WITH j AS (SELECT o_orderkey AS job_id, CAST(o_orderkey % 90 AS DOUBLE) AS done, CAST(100 AS DOUBLE) AS total, CAST(o_custkey % 300 AS DOUBLE) AS elapsed FROM orders)
SELECT job_id, round(CASE WHEN elapsed > 1 AND done > 0 THEN (total - done) / (done / elapsed) ELSE 0.0 END + total * (CASE WHEN done > 0 THEN elapsed / done ELSE 0.0 END) * 4, 6) AS eta FROM j""")  # fmt: skip
def job_eta(src: Source) -> DataFrame:
    done, elapsed = (F.col("job_id") % 90).cast("double"), (F.col("owner") % 300).cast("double")
    return _jobs(src).select("job_id", F.round(Q.eta(done, F.lit(100.0), elapsed, 3, 1), 6).alias("eta"))


@query(f"SELECT o_orderkey AS job_id, round(CASE {_STATUS} WHEN 'completed' THEN 1.0 WHEN 'failed' THEN (o_custkey % 10) / 10.0 ELSE (o_custkey % 10 + (o_orderkey % 7) / 7.0) / 10.0 END, 6)::DOUBLE AS progress FROM orders")
def job_progress(src: Source) -> DataFrame:
    return _jobs(src).select("job_id", F.round(Q.progress(F.col("status"), F.col("owner") % 10, F.lit(10), F.col("job_id") % 7, F.lit(7)), 6).alias("progress"))


_FACT = "SELECT l_returnflag AS model, l_linestatus AS prompt, CAST(l_linenumber % 2 AS BIGINT) AS scenario, l_quantity > 25 AS decode, 100 * l_discount + l_quantity AS final FROM lineitem"


def _fact(src: Source) -> DataFrame:
    return src.table("lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("prompt"), (F.col("l_linenumber") % 2).cast("long").alias("scenario"), (F.col("l_quantity") > 25).alias("decode"), (F.col("l_discount") * 100 + F.col("l_quantity")).alias("final"))


def _effect_sql() -> str:
    from itertools import combinations

    f = ["model", "prompt", "scenario", "decode"]
    parts = ["SELECT '' AS effect, '' AS level, round(avg(final), 6) AS mean, count(*) AS n FROM f"]
    for s in [*[(x,) for x in f], *combinations(f, 2)]:
        level = " || '*' || ".join(f"CAST({c} AS VARCHAR)" for c in s)
        parts.append(f"SELECT '{'*'.join(s)}', {level}, round(avg(final), 6), count(*) FROM f GROUP BY {', '.join(s)}")
    return f"WITH f AS ({_FACT}) " + " UNION ALL ".join(parts)


@query(_effect_sql())
def factorial_effects(src: Source) -> DataFrame:
    return Q.effects(_fact(src), ["model", "prompt", "scenario", "decode"], "final").withColumn("mean", F.round("mean", 6))


@query(f"WITH m AS (SELECT model, prompt, scenario, decode, avg(final) AS mean FROM ({_FACT}) f GROUP BY ALL) SELECT model, prompt, scenario, decode, round(mean, 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mean DESC, prompt, scenario, decode) AS r FROM m) t WHERE r = 1")
def factorial_best(src: Source) -> DataFrame:
    return Q.best_setting(_fact(src), "model", ["prompt", "scenario", "decode"], "final").withColumn("mean", F.round("mean", 6))


@query("SELECT l_returnflag AS model, round(avg(0.40 * l_quantity + 0.45 * l_discount * 100 + 0.15 * (100 - l_tax * 100)), 6) AS composite FROM lineitem GROUP BY l_returnflag")
def composite_score(src: Source) -> DataFrame:
    score = Q.composite(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100)
    return src.table("lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(F.round(F.avg(score), 6).alias("composite"))


_CLOCK = "lpad(CAST(CAST({0} AS BIGINT) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST({0} AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST({0} AS BIGINT) % 60 AS VARCHAR), 2, '0')"


@query(
    f"SELECT conv_id AS media, turn AS seq, concat('[', {_CLOCK.format('(5 * turn)')}, ' - ', {_CLOCK.format('(5 * turn + 4)')}, '] [', CASE WHEN turn % 3 = 0 THEN 'unknown' ELSE 'en' END, '] ', text, chr(10), '  [Vietnamese] ', CASE WHEN turn % 2 = 0 THEN concat('<', text, '>') ELSE '(untranslated)' END, chr(10), '  [German] (untranslated)') AS lines FROM conversations"
)
def transcript_render(src: Source) -> DataFrame:
    rows = src.table("conversations").select(
        F.col("conv_id").alias("media"), F.col("turn").alias("seq"), (F.col("turn") * 5).alias("start"), (F.col("turn") * 5 + 4).alias("end"), "text", F.when(F.col("turn") % 3 != 0, "en").alias("language"),
        F.create_map(F.lit("Vietnamese"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<"), "text", F.lit(">"))).otherwise(""), F.lit("German"), F.lit(None).cast("string")).alias("translated"),
    )
    return Q.transcript_lines(rows, ["Vietnamese", "German"]).select("media", "seq", "lines")


@query("SELECT conv_id AS media, max(5 * turn + 4) AS duration FROM conversations GROUP BY conv_id")
def media_duration(src: Source) -> DataFrame:
    return src.table("conversations").groupBy(F.col("conv_id").alias("media")).agg(F.coalesce(F.max(F.col("turn") * 5 + 4), F.lit(0)).alias("duration"))


_SPEECH = "SELECT user_id, CAST(epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS DOUBLE) / 1e6 AS s FROM events"
_SESSIONS = f"""SELECT user_id, min(s) AS start, max(e) AS "end", count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
 SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 3600 THEN 1 ELSE 0 END AS f FROM (SELECT user_id, s, s + 30 AS e FROM ({_SPEECH}) a) b) c) d GROUP BY user_id, g"""


def _sessions(src: Source) -> DataFrame:
    from pyspark.sql import Window as W

    t = F.expr("timestampdiff(MICROSECOND, cast('1970-01-01 00:00:00' as timestamp_ntz), cast(ts as timestamp_ntz))")
    rows = src.table("events").select("user_id", ((t - F.min(t).over(W.partitionBy("user_id"))).cast("double") / 1e6).alias("start"))
    return Q.speech_sessions(rows.withColumn("end", F.col("start") + 30), "user_id", 3600.0)


@query(f'SELECT user_id, round(start, 6) AS start, round("end", 6) AS "end", n FROM ({_SESSIONS}) s')
def speech_sessions(src: Source) -> DataFrame:
    return _sessions(src).select("user_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "n")


@query(f'SELECT user_id, round(a, 6) AS start, round(b, 6) AS "end" FROM (SELECT user_id, coalesce(lag("end") OVER (PARTITION BY user_id ORDER BY start), 0.0) AS a, start AS b FROM ({_SESSIONS}) s) t WHERE b > a')
def speech_gaps(src: Source) -> DataFrame:
    return Q.silences(_sessions(src), "user_id").select("user_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("SELECT user_id AS job_id, arg_max(event_type, ts) AS stage, max(ts) AS ts FROM (SELECT user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) e GROUP BY user_id")
def event_progress_latest(src: Source) -> DataFrame:
    return src.table("events").groupBy(F.col("user_id").alias("job_id")).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m")).select("job_id", F.col("m.event_type").alias("stage"), F.col("m.ts").alias("ts"))


@query("SELECT event_type, count(*) AS calls, round(avg(value), 6) AS mean_value, count(*) FILTER (WHERE value < 10) AS failures FROM events GROUP BY event_type")
def service_counters(src: Source) -> DataFrame:
    return src.table("events").groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.avg("value"), 6).alias("mean_value"), F.count_if(F.col("value") < 10).alias("failures"))
