"""The engine's queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import scalar as S
from riskloom.operators import evaluate as E
from riskloom.operators import knn
from riskloom.operators.best_first import search_best_first, store_shards
from riskloom.operators.decide import decide
from riskloom.operators.features import VECTOR, vectorize
from riskloom.operators.index_build import MAX_CLUSTERS, MAXS, MINS, ROUNDS, assign_centroids, build_index, cluster_table, grid_cluster, read_index, storage_order, train_centroids, write_index
from riskloom.plans.score import event_index, event_vectors, readiness, score_requests, score_vectors, split_events
from riskloom.session import cut, shared_dir
from riskloom.sources.dispatch import dispatch
from riskloom.sources.events import as_requests, request_body, transactions
from riskloom.sources.index_source import read_index_files, write_index_files
from riskloom.sources.requests import parse_requests, read_golden_set, write_golden_set, write_json
from riskloom.streaming import history_stream as H
from riskloom.streaming import watch
from riskloom.streaming.score_stream import read_request_stream, score_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(_table(spark, sf_dir, "events"))


# ---- the same in SQL, as common table expressions ---------------------------------------------------------------

_MCC = " ".join(f"WHEN {k} THEN {v}" for k, v in S.MCC_RISK.items())


def _q(x: str) -> str:
    """x, a single-precision expression, in ten-thousandths."""
    return f"CAST(floor(CAST(least(greatest({x}, 0::FLOAT), 1::FLOAT) * 10000::FLOAT AS DOUBLE) + 0.5) AS INTEGER)"


TXN_SQL = """
base AS (SELECT event_id, ts, user_id, value, CAST(value AS FLOAT) AS amount, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type, epoch_us(ts) AS us FROM events),
users AS (SELECT user_id, CAST(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS FLOAT) AS customer_avg_amount FROM base GROUP BY user_id),
merchants AS (SELECT k % 20 AS m, CAST(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS FLOAT) AS merchant_avg_amount FROM base GROUP BY k % 20),
hist AS (SELECT *, k % 20 AS m, 'MERC-' || lpad(CAST(k % 20 AS VARCHAR), 3, '0') AS merchant_id, lag(ts) OVER own AS last_ts,
         array_agg('MERC-' || lpad(CAST(k % 20 AS VARCHAR), 3, '0')) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS known,
         count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS day_count
         FROM base WINDOW own AS (PARTITION BY user_id ORDER BY ts, event_id)),
txn AS (SELECT event_id, user_id, ts, last_ts, merchant_id, amount, k % 12 + 1 AS installments, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
        customer_avg_amount, CAST(least(255, day_count) AS INTEGER) AS tx_count_24h, NOT coalesce(list_contains(known, merchant_id), false) AS is_unknown_merchant,
        CASE event_type WHEN 'click' THEN 5411 WHEN 'view' THEN 5812 WHEN 'signup' THEN 5944 WHEN 'purchase' THEN 7995 ELSE 9999 END AS mcc,
        merchant_avg_amount, k % 2 = 0 AS is_online, k % 3 = 0 AS card_present, CAST(k * 10 AS FLOAT) AS km_from_home, last_ts IS NOT NULL AS has_last_tx,
        CAST(CASE WHEN last_ts IS NOT NULL THEN epoch_us(ts) // 60000000 - epoch_us(last_ts) // 60000000 ELSE 0 END AS FLOAT) AS minutes_since_last,
        CAST(CASE WHEN last_ts IS NOT NULL THEN k * 5 ELSE 0 END AS FLOAT) AS km_from_current, CASE WHEN value > 60 OR hour(ts) < 6 THEN 1 ELSE 0 END AS label, value
        FROM hist JOIN users USING (user_id) JOIN merchants USING (m))"""

FEAT_SQL = f"""{TXN_SQL},
feat AS (SELECT event_id, label, CAST(card_present AS INTEGER) * 8 + CAST(is_online AS INTEGER) * 4 + CAST(is_unknown_merchant AS INTEGER) * 2 + CAST(has_last_tx AS INTEGER) AS tag,
 {_q('amount / 10000::FLOAT')} AS v0, {_q('CAST(installments AS FLOAT) / 12::FLOAT')} AS v1,
 CASE WHEN customer_avg_amount > 0 THEN {_q('(amount / customer_avg_amount) / 10::FLOAT')} ELSE 0 END AS v2,
 {_q('CAST(hour AS FLOAT) / 23::FLOAT')} AS v3, {_q('CAST(weekday AS FLOAT) / 6::FLOAT')} AS v4,
 CASE WHEN has_last_tx THEN {_q('minutes_since_last / 1440::FLOAT')} ELSE -10000 END AS v5, CASE WHEN has_last_tx THEN {_q('km_from_current / 1000::FLOAT')} ELSE -10000 END AS v6,
 {_q('km_from_home / 1000::FLOAT')} AS v7, {_q('CAST(tx_count_24h AS FLOAT) / 20::FLOAT')} AS v8,
 CASE WHEN is_online THEN 10000 ELSE 0 END AS v9, CASE WHEN card_present THEN 10000 ELSE 0 END AS v10, CASE WHEN is_unknown_merchant THEN 10000 ELSE 0 END AS v11,
 CASE mcc {_MCC} ELSE {S.MCC_DEFAULT} END AS v12, {_q('merchant_avg_amount / 10000::FLOAT')} AS v13 FROM txn)"""

_V = ", ".join(VECTOR)
_SHORT = ", ".join(f"CAST({v} AS SMALLINT) AS {v}" for v in VECTOR)
_DIST = " + ".join(f"(CAST(q.{v} AS BIGINT) - r.{v}) * (CAST(q.{v} AS BIGINT) - r.{v})" for v in VECTOR)
_LB = " + ".join(f"greatest(c.min{i} - q.v{i}, q.v{i} - c.max{i}, 0::BIGINT) * greatest(c.min{i} - q.v{i}, q.v{i} - c.max{i}, 0::BIGINT)" for i in range(len(VECTOR)))

_KNOWN = "event_id % 10 <> 0 AND tag < 12"


def _index(assigned: str) -> str:
    """The index and the queries over ``assigned``: the known rows of ``feat`` with a cluster each."""
    return f"""
refs AS (SELECT tag, cid, row_number() OVER (PARTITION BY tag ORDER BY cid, event_id) - 1 AS vi, label, event_id, {_V} FROM ({assigned})),
clusters AS (SELECT tag, cid, count(*) AS n, {', '.join(f'CAST(min(v{i}) AS BIGINT) AS min{i}, CAST(max(v{i}) AS BIGINT) AS max{i}' for i in range(len(VECTOR)))} FROM refs GROUP BY tag, cid),
queries AS (SELECT event_id AS qid, label, tag, {_V}, CASE WHEN tag IN (SELECT tag FROM refs) THEN tag WHEN tag & 7 IN (SELECT tag FROM refs) THEN tag & 7 WHEN tag & 3 IN (SELECT tag FROM refs) THEN tag & 3 END AS etag
            FROM feat WHERE event_id % 10 = 0)"""


INDEX_SQL = f"{FEAT_SQL},{_index(f'SELECT *, least(7, v2 // 300) * 8 + least(7, v3 // 1251) AS cid FROM feat WHERE {_KNOWN}')}"


def _lloyd() -> str:
    """Seeds c0, then by turns the nearest centroid a<r> of each row, ties to the first, and the means c<r+1>; the last step only assigns."""
    dist = " + ".join(f"(CAST(k.{v} AS BIGINT) - c.{v}) * (CAST(k.{v} AS BIGINT) - c.{v})" for v in VECTOR)
    out = [f"known AS MATERIALIZED (SELECT * FROM feat WHERE {_KNOWN})"]
    out.append(f"""c0 AS MATERIALIZED (SELECT tag, cid, {_V} FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY md5(CAST(event_id AS VARCHAR))) - 1 AS cid, count(*) OVER (PARTITION BY tag) AS n FROM known)
  WHERE cid < least({MAX_CLUSTERS}, CAST(floor(sqrt(n)) AS BIGINT)))""")
    for r in range(ROUNDS + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT k.event_id, arg_min(c.cid, ({dist}) * {MAX_CLUSTERS} + c.cid) AS cid FROM known k JOIN c{r} c ON k.tag = c.tag GROUP BY k.event_id)")
        if r < ROUNDS:
            means = ", ".join(f"CAST(sum({v}) // count(*) AS BIGINT) AS {v}" for v in VECTOR)
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT tag, row_number() OVER (PARTITION BY tag ORDER BY cid) - 1 AS cid, {_V} FROM (SELECT tag, cid, {means} FROM known JOIN a{r} USING (event_id) GROUP BY tag, cid))")
    return ",\n".join(out)


KMEANS_SQL = f"{FEAT_SQL},\n{_lloyd()},{_index(f'SELECT known.*, cid FROM known JOIN a{ROUNDS} USING (event_id)')}"


def _exact(index: str) -> str:
    return f"""{index},
near AS (SELECT q.qid, r.vi, r.label, {_DIST} AS dist, row_number() OVER (PARTITION BY q.qid ORDER BY {_DIST}, r.vi) AS nr FROM queries q JOIN refs r ON q.etag = r.tag),
exact AS (SELECT q.qid, q.label, q.etag, CAST(coalesce(sum(n.label), 0) AS INTEGER) AS votes FROM queries q LEFT JOIN near n ON q.qid = n.qid AND n.nr <= 5 GROUP BY q.qid, q.label, q.etag)"""


def _probe(index: str) -> str:
    return f"""{_exact(index)},
ranked AS (SELECT q.qid, q.etag, c.cid, CAST({_LB} AS BIGINT) AS lb, row_number() OVER (PARTITION BY q.qid ORDER BY {_LB}, c.cid) AS rank FROM queries q JOIN clusters c ON q.etag = c.tag),
near12 AS (SELECT q.qid, r.vi, r.label, row_number() OVER (PARTITION BY q.qid ORDER BY {_DIST}, r.vi) AS nr FROM ranked p JOIN queries q ON p.qid = q.qid JOIN refs r ON r.tag = p.etag AND r.cid = p.cid WHERE p.rank <= 12),
first AS (SELECT q.qid, CAST(coalesce(sum(n.label), 0) AS INTEGER) AS votes FROM queries q LEFT JOIN near12 n ON q.qid = n.qid AND n.nr <= 5 GROUP BY q.qid),
ivf AS (SELECT f.qid, CASE WHEN f.votes BETWEEN 1 AND 4 THEN e.votes ELSE f.votes END AS votes, f.votes BETWEEN 1 AND 4 AS repaired FROM first f JOIN exact e ON f.qid = e.qid)"""


EXACT_SQL, PROBE_SQL, KMEANS_PROBE_SQL = _exact(INDEX_SQL), _probe(INDEX_SQL), _probe(KMEANS_SQL)

_ANSWER = "CAST(least(votes, 5) / 5.0 AS DOUBLE) AS fraud_score, votes < 3 AS approved, '{\"approved\":' || CASE WHEN votes < 3 THEN 'true' ELSE 'false' END || ',\"fraud_score\":' || printf('%.1f', least(votes, 5) / 5.0) || '}' AS response"


# ---- features ---------------------------------------------------------------------------------------------------


@query(f"WITH {EXACT_SQL} SELECT qid, votes, {_ANSWER} FROM exact")
def fraud_score_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, index = event_index(spark, sf_dir)
    return score_vectors(queries, index, "exact")


@query(f"WITH {FEAT_SQL} SELECT event_id, label, tag, {_SHORT} FROM feat")
def txn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_vectors(spark, sf_dir)


@query(f"WITH {FEAT_SQL} SELECT tag, count(*) AS n, CAST(sum(label) AS BIGINT) AS fraud FROM feat GROUP BY tag")
def txn_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_vectors(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("n"), F.sum("label").alias("fraud"))


@query(f"WITH {TXN_SQL} SELECT CAST(mcc AS BIGINT) AS mcc, CASE mcc {_MCC} ELSE {S.MCC_DEFAULT} END AS risk, count(*) AS n FROM txn GROUP BY mcc")
def mcc_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _txns(spark, sf_dir).groupBy("mcc").agg(F.count("*").alias("n")).select("mcc", S.mcc_risk(F.col("mcc")).alias("risk"), "n")


@query("SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(epoch_us(ts) // 86400000000 AS INTEGER) AS day_number FROM events")
def weekday_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = S.iso_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return _table(spark, sf_dir, "events").select("event_id", F.hour(ts).alias("hour"), S.weekday(ts).alias("weekday"), S.day_number(ts).alias("day_number"))


@query(f"WITH {TXN_SQL} SELECT event_id, has_last_tx, CAST(minutes_since_last AS BIGINT) AS minutes FROM txn")
def minutes_since_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _txns(spark, sf_dir).select("event_id", "has_last_tx", F.col("minutes_since_last").cast("bigint").alias("minutes"))


@query(f"WITH {TXN_SQL} SELECT event_id, merchant_id, is_unknown_merchant FROM txn")
def known_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _txns(spark, sf_dir).select("event_id", "merchant_id", "is_unknown_merchant")


@query("SELECT event_id, CAST(floor(CAST(least(greatest(CAST(value AS FLOAT) / 100::FLOAT, 0::FLOAT), 1::FLOAT) * 10000::FLOAT AS DOUBLE) + 0.5) AS INTEGER) AS q, (event_id + 63) // 64 * 64 AS aligned FROM events")
def quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", S.clamp01(S.ratio32(F.col("value"), F.lit(100.0))).alias("q"), S.align(F.col("event_id")).alias("aligned"))


# ---- requests and answers ---------------------------------------------------------------------------------------


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies, of every twenty five spoilt in five ways and one with another key order."""
    body, kind = F.col("body"), F.col("event_id") % 20
    spoilt = (
        F.when(kind == 1, F.lit("not json"))
        .when(kind == 2, F.regexp_replace(body, '"installments":[0-9]+', '"installments":300'))
        .when(kind == 3, F.regexp_replace(body, r'"requested_at":"(\d{4})-\d\d', r'"requested_at":"$1-13'))
        .when(kind == 4, F.regexp_replace(body, r'"amount":([0-9.E+-]+)', r'"amount":"$1"'))
        .when(kind == 5, F.regexp_replace(body, r',"last_transaction":.*$', "}"))
        .when(kind == 6, F.concat(F.regexp_replace(F.lit('{"extra":[1],"terminal":'), "x^", ""), F.regexp_extract(body, r'"terminal":(\{[^}]*\})', 1), F.lit(","), F.regexp_replace(F.expr("substring(body, 2)"), r'"terminal":\{[^}]*\},', "")))
        .otherwise(body)
    )
    return as_requests(_txns(spark, sf_dir)).select("event_id", "label", spoilt.alias("body"))


@query(f"WITH {FEAT_SQL} SELECT event_id, label, tag, {_SHORT} FROM feat WHERE event_id % 20 NOT BETWEEN 1 AND 5")
def json_parse_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorize(parse_requests(_bodies(spark, sf_dir)).filter("valid"), "event_id", "label")


@query("SELECT event_id, 400 AS status FROM events WHERE event_id % 20 BETWEEN 1 AND 5")
def json_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_requests(_bodies(spark, sf_dir)).filter("not valid").select("event_id", "status")


@query(f"WITH votes AS (SELECT event_id, CAST(event_id % 7 AS INTEGER) AS votes FROM events) SELECT event_id, votes, {_ANSWER} FROM votes")
def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(_table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 7).cast("int").alias("votes")))


@query(f"WITH votes AS (SELECT event_id, CAST(event_id % 7 AS INTEGER) AS votes FROM events) SELECT event_id, {_ANSWER} FROM votes")
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written as JSON lines and read back."""
    path = _scratch(spark, "answers")
    write_json(response_json(spark, sf_dir).select("event_id", "fraud_score", "approved", "response"), path)
    return spark.read.schema("event_id bigint, fraud_score double, approved boolean, response string").json(path)


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) % 8 AS INTEGER) AS worker FROM events")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests dealt in turn to eight workers."""
    return dispatch(_table(spark, sf_dir, "events").select("event_id"), 8, "event_id")


@query(f"WITH {INDEX_SQL} SELECT CAST(t.tag AS INTEGER) AS tag, count(n) AS clusters, CAST(coalesce(sum(n), 0) AS BIGINT) AS vectors, coalesce(sum(n), 0) > 0 AS ready FROM range(12) t(tag) LEFT JOIN clusters c ON c.tag = t.tag GROUP BY t.tag")
def ready_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness((None, cluster_table(_assigned(spark, sf_dir))))


# ---- index ------------------------------------------------------------------------------------------------------


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_events(event_vectors(spark, sf_dir))[1].withColumn("cid", grid_cluster())


def _wide(cols: list[str]) -> list[Column]:
    return [F.col(c).cast("bigint").alias(c) for c in cols]


@query(f"WITH {INDEX_SQL} SELECT tag, cid, n, {', '.join(MINS + MAXS)} FROM clusters")
def cluster_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_table(_assigned(spark, sf_dir)).select("tag", "cid", "n", *_wide(MINS + MAXS))


@query(f"WITH {INDEX_SQL} SELECT tag, cid, CAST(coalesce(sum(n) OVER (PARTITION BY tag ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, n FROM clusters")
def cluster_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_table(_assigned(spark, sf_dir)).select("tag", "cid", "first", "n")


@query(f"WITH {INDEX_SQL} SELECT tag, cid, vi, label, {_SHORT} FROM refs")
def index_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage_order(_assigned(spark, sf_dir), "vec_id").select("tag", "cid", "vi", "label", *VECTOR)


def _scratch(spark: SparkSession, what: str) -> str:
    """A new folder that all executors share."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@query(f"WITH {INDEX_SQL} SELECT tag, cid, vi, label, {_SHORT} FROM refs")
def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after it was stored and opened again, every tag that was written being checked for."""
    known = split_events(event_vectors(spark, sf_dir))[1]
    path = _scratch(spark, "index")
    refs, clusters = build_index(known, assigner="grid")
    tags = tuple(r.tag for r in clusters.select("tag").distinct().collect())  # at most 16
    write_index(refs, clusters, path)
    return read_index(spark, path, tags)[0].select("tag", "cid", "vi", "label", *VECTOR)


def _binary_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The grid index after it was stored as binary files and read in ranges of clusters."""
    path = _scratch(spark, "files")
    write_index_files(build_index(split_events(event_vectors(spark, sf_dir))[1], assigner="grid")[0], path)
    return read_index_files(spark, path)


@query(f"WITH {INDEX_SQL} SELECT tag, cid, vi, label, {_SHORT} FROM refs")
def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binary_index(spark, sf_dir)[0].select("tag", "cid", "vi", "label", *VECTOR)


@query(f"WITH {INDEX_SQL}, o AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY tag ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM clusters) SELECT tag, cid, n, first, {', '.join(MINS + MAXS)} FROM o")
def index_file_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binary_index(spark, sf_dir)[1].select("tag", "cid", "n", "first", *_wide(MINS + MAXS))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, (_, clusters) = event_index(spark, sf_dir)
    return knn.rank_clusters(knn.with_effective_tag(queries, clusters), clusters)


@query(f"WITH {PROBE_SQL} SELECT qid, etag, cid, lb FROM ranked")
def bbox_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("qid", "etag", "cid", "lb")


@query(f"WITH {PROBE_SQL} SELECT qid, cid, rank FROM ranked WHERE rank <= 12")
def cluster_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).filter(F.col("rank") <= knn.PROBES).select("qid", "cid", F.col("rank").cast("bigint").alias("rank"))


# ---- neighbours -------------------------------------------------------------------------------------------------


@query(f"WITH {EXACT_SQL} SELECT q.qid, n.nr AS nr, CAST(n.dist AS BIGINT) AS dist, n.label FROM queries q JOIN near n ON q.qid = n.qid AND n.nr <= 5")
def knn_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, index = event_index(spark, sf_dir)
    rows = knn.search_exact(queries, *index).select("qid", F.posexplode("near").alias("p", "n"))
    return rows.select("qid", (F.col("p") + 1).cast("bigint").alias("nr"), "n.dist", "n.label")


@query(f"WITH {KMEANS_PROBE_SQL} SELECT qid, votes FROM first")
def knn_probe12(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, index = event_index(spark, sf_dir, "kmeans")
    return knn.probe_votes(queries, *index).select("qid", "votes")


@query(f"WITH {KMEANS_PROBE_SQL} SELECT qid, votes, {_ANSWER} FROM ivf")
def ivf_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, index = event_index(spark, sf_dir, "kmeans")
    return score_vectors(queries, index, "ivf")


@query(f"WITH {KMEANS_PROBE_SQL} SELECT qid, votes FROM ivf WHERE repaired")
def ivf_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, index = event_index(spark, sf_dir, "kmeans")
    return knn.search_ivf(queries, *index).filter("repaired").select("qid", "votes")


@query(f"WITH {INDEX_SQL} SELECT qid, tag, etag FROM queries")
def tag_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, (_, clusters) = event_index(spark, sf_dir)
    return knn.with_effective_tag(queries, clusters).select("qid", "tag", "etag")


def _recall_sql(probe: str) -> str:
    return f"""WITH {probe}, sizes AS (SELECT qid, count(*) AS n FROM near WHERE nr <= 5 GROUP BY qid),
    met AS (SELECT e.qid, count(*) AS n FROM near e JOIN near12 p ON e.qid = p.qid AND e.vi = p.vi WHERE e.nr <= 5 AND p.nr <= 5 GROUP BY e.qid)
    SELECT count(*) AS queries, round(CAST(sum(CASE WHEN i.repaired THEN s.n ELSE coalesce(m.n, 0) END) AS DOUBLE) / sum(s.n), 9) AS recall, round(avg(CASE WHEN i.votes = x.votes THEN 1.0::DOUBLE ELSE 0 END), 9) AS same_votes
    FROM ivf i JOIN exact x USING (qid) LEFT JOIN sizes s USING (qid) LEFT JOIN met m USING (qid)"""


def _recall(spark: SparkSession, sf_dir: str, assigner: str) -> DataFrame:
    queries, index = event_index(spark, sf_dir, assigner)
    row = knn.recall(knn.search_ivf(queries, *index), knn.search_exact(queries, *index))
    return row.select("queries", F.round("recall", 9).alias("recall"), F.round("same_votes", 9).alias("same_votes"))


@query(_recall_sql(KMEANS_PROBE_SQL))
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probing against exact search on the k-means index."""
    return _recall(spark, sf_dir, "kmeans")


@query(_recall_sql(PROBE_SQL))
def ann_recall_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probing against exact search on the grid index."""
    return _recall(spark, sf_dir, "grid")


@query(f"WITH {KMEANS_SQL} SELECT tag, cid, vi, event_id AS vec_id FROM refs")
def kmeans_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster and the place of every reference in the k-means index."""
    known = cut(split_events(event_vectors(spark, sf_dir))[1])
    placed = storage_order(assign_centroids(known, train_centroids(known)), "vec_id")
    return placed.select("tag", F.col("cid").cast("bigint").alias("cid"), "vi", "vec_id")


@query(f"WITH {KMEANS_SQL} SELECT tag, cid, n, {', '.join(MINS + MAXS)} FROM clusters")
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of the k-means index."""
    _, (_, clusters) = event_index(spark, sf_dir, "kmeans")
    return clusters.select("tag", F.col("cid").cast("bigint").alias("cid"), "n", *_wide(MINS + MAXS))


@query(f"WITH {_exact(KMEANS_SQL)} SELECT q.qid, n.nr AS nr, CAST(n.dist AS BIGINT) AS dist, n.label FROM queries q JOIN near n ON q.qid = n.qid AND n.nr <= 5")
def knn_best_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact neighbours by branch and bound over the stored shards of the k-means index."""
    queries, index = event_index(spark, sf_dir, "kmeans")
    rows = search_best_first(queries, *store_shards(*index)).select("qid", F.posexplode("near").alias("p", "n"))
    return rows.select("qid", (F.col("p") + 1).cast("bigint").alias("nr"), "n.dist", "n.label")


_EMBED = "(SELECT vec_id AS qid, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0) q JOIN (SELECT vec_id AS rid, label, embedding::DOUBLE[] AS e FROM embeddings) r ON q.qid <> r.rid"


@query(
    f"""WITH near AS (SELECT qid, rid, label, row_number() OVER (PARTITION BY qid ORDER BY round(list_distance(q.e, r.e), 6), rid) AS nr FROM {_EMBED}),
    tally AS (SELECT qid, label, count(*) AS n, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, label) AS nr FROM near WHERE nr <= 5 GROUP BY qid, label),
    ids AS (SELECT qid, string_agg(CAST(rid AS VARCHAR), ',' ORDER BY rid) AS near FROM near WHERE nr <= 5 GROUP BY qid)
    SELECT t.qid, near, label AS vote, n AS votes FROM tally t JOIN ids USING (qid) WHERE t.nr = 1"""
)
def embedding_knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors with an id divisible by 100 against all others."""
    rows = _table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    found = knn.embedding_neighbours(rows.filter("id % 100 = 0"), rows)
    tally = found.groupBy("qid", "label").agg(F.count("*").alias("n"), F.collect_list("rid").alias("r"))
    best = F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("b")
    return tally.groupBy("qid").agg(F.array_join(F.array_sort(F.flatten(F.collect_list("r"))), ",").alias("near"), best).select("qid", "near", (-F.col("b.l")).alias("vote"), F.col("b.n").alias("votes"))


@query("SELECT a.vec_id AS qid, b.vec_id AS rid, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS dist FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 10")
def embedding_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    pairs = e.select(F.col("vec_id").alias("qid"), F.col("e").alias("a"), (F.col("vec_id") - F.col("vec_id") % 10).alias("rid")).join(e.select(F.col("vec_id").alias("rid"), F.col("e").alias("b")), "rid")
    return pairs.select("qid", "rid", F.round(F.sqrt(knn.array_distance(F.col("a"), F.col("b"))), 5).alias("dist"))


# ---- evaluation -------------------------------------------------------------------------------------------------

_CONFUSION_SQL = f"""{EXACT_SQL},
decided AS (SELECT qid, votes < 3 AS approved, label = 0 AS expected_approved, CASE WHEN qid % 70 = 0 THEN 500 ELSE 200 END AS status FROM exact),
counts AS (SELECT count(*) FILTER (status = 200 AND NOT approved AND NOT expected_approved) AS tp, count(*) FILTER (status = 200 AND approved AND expected_approved) AS tn,
  count(*) FILTER (status = 200 AND NOT approved AND expected_approved) AS fp, count(*) FILTER (status = 200 AND approved AND NOT expected_approved) AS fn, count(*) FILTER (status <> 200) AS errors FROM decided),
weighted AS (SELECT *, tp + tn + fp + fn + errors AS n, fp + 3 * fn + 5 * errors AS weighted_errors, fp + fn + errors AS failures FROM counts),
rates AS (SELECT *, CASE WHEN n > 0 THEN weighted_errors / n ELSE 0 END AS epsilon, CASE WHEN n > 0 THEN failures / n ELSE 0 END AS failure_rate FROM weighted)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, index = event_index(spark, sf_dir)
    answers = score_vectors(queries, index, "exact").join(queries.select("qid", "label"), "qid")
    return answers.select("qid", "approved", (F.col("label") == 0).alias("expected_approved"), F.when(F.col("qid") % 70 == 0, 500).otherwise(200).alias("status"), "response")


@query(f"WITH {_CONFUSION_SQL} SELECT tp, tn, fp, fn, errors FROM counts")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(_decided(spark, sf_dir))


@query(f"WITH {EXACT_SQL} SELECT count(*) FILTER (votes >= 3 AND label = 1) AS tp, count(*) FILTER (votes < 3 AND label = 0) AS tn, count(*) FILTER (votes >= 3 AND label = 0) AS fp, count(*) FILTER (votes < 3 AND label = 1) AS fn, 0::BIGINT AS errors FROM exact")
def golden_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query events as documents of labelled entries, read back, scored and compared."""
    _, index = event_index(spark, sf_dir)
    path = _scratch(spark, "golden")
    asks = as_requests(_txns(spark, sf_dir)).filter("event_id % 10 = 0")
    write_golden_set(asks.select("event_id", "body", (F.col("label") == 0).alias("expected_approved")), path, "event_id")
    entries = cut(read_golden_set(spark, path, lines=True).withColumn("qid", F.monotonically_increasing_id()))
    answers = score_requests(entries, index, "exact").select("qid", "status", "approved")
    return E.confusion(entries.select("qid", "expected_approved").join(answers, "qid"))


@query(
    f"""WITH {_CONFUSION_SQL}, p AS (SELECT quantile_cont(value, 0.99) AS p99_ms FROM events),
    s AS (SELECT *, CASE WHEN p99_ms <= 0 THEN 0 WHEN p99_ms > 2000 THEN -3000 ELSE 1000 * log10(1000 / greatest(p99_ms, 1)) END AS a,
      CASE WHEN failure_rate > 0.15 THEN -3000 ELSE 1000 * log10(1 / greatest(epsilon, 0.001)) - 300 * log10(1 + weighted_errors) END AS d FROM rates, p)
    SELECT n, weighted_errors, failures, round(epsilon, 6) AS epsilon, round(failure_rate, 6) AS failure_rate, round(a, 4) AS p99_score, round(d, 4) AS detection_score, round(a + d, 4) AS final_score, failure_rate > 0.15 AS detection_cut, p99_ms > 2000 AS p99_cut FROM s"""
)
def detection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p99 = E.exact_percentiles(_table(spark, sf_dir, "events"), "value", [0.99])[0]
    row = E.report(E.confusion(_decided(spark, sf_dir)), F.lit(p99).cast("double"))
    rounded = lambda c, n: F.round(c, n).alias(c)
    return row.select("n", "weighted_errors", "failures", rounded("epsilon", 6), rounded("failure_rate", 6), rounded("p99_score", 4), rounded("detection_score", 4), rounded("final_score", 4), "detection_cut", "p99_cut")


@query(f"SELECT count(value) AS requests, {', '.join(f'round(quantile_cont(value, {p}), 6) AS {n}' for n, p in E.PERCENTILES)}, round(max(value), 6) AS max_ms FROM events")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latency_percentiles(_table(spark, sf_dir, "events"), "value", digits=6)


@query(
    f"""WITH {TXN_SQL}, c AS (SELECT count(*) AS total, count(*) FILTER (label = 1) AS fraud_count, count(*) FILTER (label = 0) AS legit_count, count(*) FILTER (abs(value - 60) < 1) AS edge_case_count FROM txn)
    SELECT *, round(fraud_count / total, 4) AS fraud_rate, round(legit_count / total, 4) AS legit_rate, round(edge_case_count / total, 4) AS edge_case_rate FROM c"""
)
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    return E.dataset_stats(rows, (F.col("value") > 60) | (F.hour("ts") < 6), F.abs(F.col("value") - 60) < 1)


@query("SELECT i AS request, n_name FROM range(60) t(i) JOIN nation ON n_nationkey = i % (SELECT count(*) FROM nation)")
def replay_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.replay(_table(spark, sf_dir, "nation"), 60, idx="n_nationkey").select("request", "n_name")


@query(
    f"""WITH {EXACT_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (qid % 70 <> 0) AS ok FROM exact), t AS (SELECT 'status is 200' AS name, ok AS passes, n - ok AS fails FROM c
    UNION ALL SELECT 'body is json', n, 0 FROM c UNION ALL SELECT 'approved is boolean', n, 0 FROM c UNION ALL SELECT 'fraud_score is number', n, 0 FROM c)
    SELECT name, passes, fails, passes / (passes + fails) AS rate, fails = 0 AS ok FROM t"""
)
def response_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.thresholds(E.checks(_decided(spark, sf_dir)))


# ---- streaming --------------------------------------------------------------------------------------------------


@query(f"WITH {KMEANS_PROBE_SQL} SELECT qid, 200 AS status, votes, {_ANSWER} FROM ivf")
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query events as a stream of JSON requests, scored in micro-batches from a folder."""
    txns = _txns(spark, sf_dir)
    rows = cut(vectorize(txns, "event_id", "label", F.when(F.col("event_id") % 10 == 0, request_body()).alias("body")))  # transactions are derived once
    index = build_index(split_events(rows.drop("body"))[1])
    root = _scratch(spark, "stream")
    asks = rows.filter("event_id % 10 = 0").select(F.col("event_id").alias("qid"), "body", "label")
    asks.repartition(4).write.json(f"{root}/in")
    stream = score_stream(read_request_stream(spark, f"{root}/in", files_per_batch=2), index, f"{root}/out", f"{root}/state")
    stream.awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch")


def _arriving(spark: SparkSession, rows: DataFrame, root: str, parts: int = 4) -> DataFrame:
    """``rows`` (event_id, ts) as a stream: each arrives up to half an hour late, in no order within its part of the time.

    A last row, with event_id -1, comes three days after all others, so that the watermark passes them.
    """
    rows = cut(rows)
    us = S.micros(F.col("ts"))
    arrival = us + F.pmod(F.hash("event_id"), F.lit(1800)).cast("bigint") * 1000000
    lo, hi, last = rows.agg(F.min(arrival), F.max(arrival), F.max("ts")).first()
    if lo is not None:
        part = F.least(F.lit(parts - 1), F.floor((arrival - F.lit(lo)) * parts / F.lit(max(1, hi - lo))))
        for i in range(parts):
            rows.filter(part == i).repartition(F.hash("event_id")).write.parquet(f"{root}/in/{i}")
        end = [F.lit(-1).cast(rows.schema["event_id"].dataType).alias(c) if c == "event_id" else F.lit(last + timedelta(days=3)).cast(t).alias(c) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]
        spark.range(1).select(*end).write.parquet(f"{root}/in/{parts}")
    else:
        rows.write.parquet(f"{root}/in/0")
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in/*")


@query(f"WITH {TXN_SQL} SELECT event_id, epoch_us(last_ts) AS last_us, coalesce(array_to_string(known, ','), '') AS known, day_count FROM hist")
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of every event, kept by a stateful stream from late and shuffled rows."""
    root = _scratch(spark, "history")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.concat(F.lit("MERC-"), F.lpad((k % 20).cast("string"), 3, "0")).alias("merchant_id"))
    stream = H.history_stream(_arriving(spark, rows, root).withColumn("us", S.micros(F.col("ts"))))
    H.start(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out").select("event_id", S.micros(F.col("last_ts")).alias("last_us"), F.array_join("known_merchants", ",").alias("known"), "day_count")


@query(
    f"""WITH {_CONFUSION_SQL}, live AS (SELECT d.*, (epoch_us(e.ts) // 21600000000) * 21600 AS window_start, value FROM decided d JOIN events e ON e.event_id = d.qid)
    SELECT window_start, count(*) AS n, count(*) FILTER (status = 200 AND NOT approved AND NOT expected_approved) AS tp, count(*) FILTER (status = 200 AND approved AND expected_approved) AS tn,
      count(*) FILTER (status = 200 AND NOT approved AND expected_approved) AS fp, count(*) FILTER (status = 200 AND approved AND NOT expected_approved) AS fn, count(*) FILTER (status <> 200) AS errors,
      max(value) AS max_ms, true AS p99_holds FROM live GROUP BY window_start"""
)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by six hours of the stream; p99_holds: the sketch's p99 has its rank within the stated error."""
    root = _scratch(spark, "windows")
    events = _table(spark, sf_dir, "events").select("event_id", "ts", F.col("value").alias("ms"))
    live = cut(_decided(spark, sf_dir).withColumnRenamed("qid", "event_id").drop("response").join(events, "event_id"))
    report = watch.window_report(_arriving(spark, live, root), width="6 hours", delay="1 hour")
    stored = H.start(report, f"{root}/out", f"{root}/state")
    stored.awaitTermination()
    out = spark.read.schema(report.schema).parquet(f"{root}/out").withColumn("window_start", F.unix_seconds("window_start"))
    held = live.select((F.floor(S.micros(F.col("ts")) / 21600000000) * 21600).cast("bigint").alias("window_start"), "ms").join(out.select("window_start", "p99_ms"), "window_start")
    ranks = held.groupBy("window_start").agg(F.avg((F.col("ms") < F.col("p99_ms")).cast("int")).alias("below"), F.avg((F.col("ms") <= F.col("p99_ms")).cast("int")).alias("upto"))
    e = watch.rank_error()
    holds = ((F.col("below") <= 0.99 + e) & (F.col("upto") >= 0.99 - e)).alias("p99_holds")
    return out.join(ranks, "window_start").select("window_start", "n", "tp", "tn", "fp", "fn", "errors", "max_ms", holds)


@query(
    """WITH gaps AS (SELECT user_id, event_id, epoch_us(ts) AS us, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 10800000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM gaps)
    SELECT user_id, min(us) AS start_us, max(us) + 10800000000 AS end_us, count(*) AS n, max(value) AS highest FROM runs GROUP BY user_id, run"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, three hours apart, from the stream of events."""
    root = _scratch(spark, "sessions")
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    found = watch.sessions(_arriving(spark, rows, root), "user_id", "ts", "3 hours", "1 hour", F.max("value").alias("highest"))
    H.start(found, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{root}/out").select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n", "highest")
