"""The queries of this subpackage: thin digests over the operators, on whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import bounded_sample, id_remainder, table


def op8_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.classlm import train_and_score

    return train_and_score(table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 7) == 2)


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.simhash import simhash_groups

    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

#: Labelled ids of each class that are looked up for the toxicity classifier, about.
LABELS = 20_000


def op1_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.langid import fit, identify

    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    net = fit(docs.filter(~held_out))
    return identify(docs.select("doc_id", "text"), net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.toolcalls import TURN_PARAMETERS, link, parameters_table, turns_as_calls

    calls, results = turns_as_calls(table(spark, sf_dir, "conversations"))
    linked = link(calls, results, parameters_table(spark, TURN_PARAMETERS))
    return linked.withColumn("violations", F.array_join("violations", "; "))


#: Turns are calls and results as in ``turns_as_calls``; levels are the longest ways back over dependencies.
TOOL_CALLS_SQL = """
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS call_id, CASE role WHEN 'user' THEN 'ask' ELSE 'instruct' END AS name, text, length(text) AS chars,
         md5(conv_id || ':' || turn) AS digest, substr(md5(conv_id || ':' || turn), 1, 1) AS kind
  FROM conversations WHERE role IN ('user', 'system')
), edges AS (
  SELECT c.conv_id, c.call_id, d.call_id AS dep, d.turn > c.turn AS forward FROM raw c JOIN raw d ON c.conv_id = d.conv_id AND abs(c.turn - d.turn) BETWEEN 1 AND 2 AND d.digest < c.digest
), levels AS (
  SELECT call_id, 0 AS level FROM raw UNION SELECT e.call_id, level + 1 FROM levels l JOIN edges e ON e.dep = l.call_id
), longest AS (
  SELECT call_id, max(level) AS level FROM levels GROUP BY call_id
), calls AS (
  SELECT raw.*, row_number() OVER (PARTITION BY raw.conv_id ORDER BY CASE WHEN raw.conv_id IN (SELECT conv_id FROM edges WHERE forward) THEN level ELSE 0 END, turn) AS topo_order FROM raw JOIN longest USING (call_id)
), results AS (
  SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id, text AS result FROM conversations WHERE role = 'assistant'
), checked AS (
  SELECT *, list_filter([
    CASE WHEN kind = '2' THEN 'chars: string for integer' WHEN chars < 1 THEN 'chars: below minimum' WHEN name = 'ask' AND chars > 400 THEN 'chars: above maximum' END,
    CASE WHEN chars > CASE name WHEN 'ask' THEN 600 ELSE 200 END THEN 'text: too long' END,
    CASE WHEN kind = '0' THEN 'turn: missing' WHEN turn < 0 THEN 'turn: below minimum' WHEN name = 'instruct' AND turn > 0 THEN 'turn: above maximum' END,
    CASE WHEN kind = '1' THEN 'extra: unknown parameter' END
  ], lambda x: x IS NOT NULL) AS found FROM calls
), linked AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.call_id, r.call_id) AS call_id, c.name,
         CASE WHEN c.call_id IS NULL THEN 'orphan_result' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
         coalesce(c.found, []) AS found, CASE WHEN r.call_id IS NULL THEN 0 ELSE 1 END::BIGINT AS n_results, c.topo_order, c.text, c.chars, c.kind, c.turn AS call_turn, r.result
  FROM checked c FULL OUTER JOIN results r ON c.call_id = r.call_id
)
SELECT conv_id, turn, call_id, name, status, len(found) = 0 AS valid, array_to_string(found, '; ') AS violations, n_results, topo_order,
  '{"arguments":' || CASE WHEN call_turn IS NULL THEN 'null' ELSE '{"chars":' || CASE WHEN kind = '2' THEN '"' || chars || '"' ELSE CAST(chars AS VARCHAR) END || CASE WHEN kind = '1' THEN ',"extra":true' ELSE '' END
    || ',"text":' || to_json(text)::VARCHAR || CASE WHEN kind = '0' THEN '' ELSE ',"turn":' || call_turn END || '}' END
  || ',"id":' || to_json(call_id)::VARCHAR || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null') || ',"result":' || coalesce(to_json(result)::VARCHAR, 'null')
  || ',"status":' || to_json(status)::VARCHAR || ',"violations":' || to_json(found)::VARCHAR || '}' AS json
FROM linked
"""


def mix_target(source: str) -> int:
    """The target weight of a source in the query: 1 to 9, from the MD5 of its name."""
    return 1 + int(hashlib.md5(source.encode()).hexdigest()[:6], 16) % 9


def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), weights=mix_target)


def op4_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.multiset import fingerprint_documents, render

    prints = fingerprint_documents(table(spark, sf_dir, "documents"))
    return prints.select("doc_id", "n_chars", "edited_sha256", render(F.col("lanes")).alias("fingerprint"), render(F.col("edited_lanes")).alias("edited_fingerprint"), "near_edited", "near_next")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.tokencounts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.quality import fit, resample, weigh

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    weighed = weigh(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
    return resample(weighed, k=docs.count() // 4, key=F.col("row")).drop("row")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").filter(~held_out & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = [bounded_sample(labels.filter(F.col("toxic") == y), F.col("doc_id"), LABELS) for y in (0, 1)]
    model = fit(docs.join(F.broadcast(few[0].unionByName(few[1])), "doc_id"))  # about LABELS ids of each class at most
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.filteraudit import COUNTS, audit, failed_sets

    found = audit(failed_sets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return found.select("part", "filter_order", "step", *[F.col(c).cast("bigint").alias(c) for c in (*COUNTS, "shapley")])


#: Every order applied step by step to every document's own failures.
FILTER_AUDIT_SQL = """
WITH RECURSIVE letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT '' AS o UNION ALL SELECT o || f FROM orders JOIN letters ON NOT contains(o, f)),
steps AS (SELECT o AS filter_order, s AS step, substr(o, CAST(s AS BIGINT), 1) AS f, substr(o, 1, CAST(s AS BIGINT) - 1) AS before FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS again FROM documents),
marked AS (SELECT part, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 2 * length(body) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN again THEN 'E' ELSE '' END) AS fails,
  coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic FROM texts),
sets AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM marked GROUP BY part, fails),
seen AS (SELECT part, filter_order, step, f, fails, n, good, toxic, contains(fails, f) AS own, fails <> '' AND length(translate(fails, before, '')) < length(fails) AS gone FROM sets, steps),
counted AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (own AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails, coalesce(sum(good) FILTER (own AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT gone), 0) AS toxic_lost FROM seen GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.phrases import mine

    return mine(table(spark, sf_dir, "documents"))


#: Every phrase of every piece, counted as text.
COLLOCATIONS_SQL = """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
split AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
words AS (SELECT id, lang, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM split),
five AS (SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4, lead(w1, 4) OVER p AS w5 FROM words WINDOW p AS (PARTITION BY id ORDER BY i)),
grams AS (SELECT lang, 1 AS m, w1 AS phrase FROM five UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM five WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM five WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM five WHERE w4 IS NOT NULL UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM five WHERE w5 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, phrase, m, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY lang, phrase, m HAVING count(*) >= 100),
sizes AS (SELECT lang, CAST(count(*) AS HUGEINT) AS n FROM words GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, phrase, m, f, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (SELECT lang, phrase, m, f AS a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
scored AS (SELECT u.lang, u.phrase, u.m, a, l.f AS l, r.f AS r, n, k, 1000 * a * n // (l.f * r.f) AS score FROM cuts u JOIN f l ON l.lang = u.lang AND l.phrase = lp JOIN f r ON r.lang = u.lang AND r.phrase = rp JOIN sizes s ON s.lang = u.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT DISTINCT lang, f, array_to_string(w[b:b + n - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - n + 2)) AS b FROM (SELECT *, unnest(range(2, m)) AS n FROM cand))),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.f >= 100 * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


#: (verdict, host, path). Fixed values.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where no rule fits, a page is blocked if some page gives its canonical URL with a feed's mark (utm_source)."""
    from riskloom.llm.urlfilter import canonical, judge

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    marked = pages.filter(F.col("url").rlike("[?&]utm_source=")).select(canonical(F.col("url")).alias("url"))
    return judge(pages, URL_RULES, marked).select("page_id", "host", "path", "rule", "verdict", "listed")


URL_FILTER_SQL = """
WITH parts AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
  list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS query FROM pages),
spelt AS (SELECT *, CASE WHEN contains(url, '://') THEN host || regexp_replace(path, '(/|[.]html)$', '') || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS canonical FROM parts),
seen AS (SELECT DISTINCT canonical FROM spelt WHERE regexp_matches(url, '[?&]utm_source=') AND canonical IS NOT NULL),
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(v, h, p)),
fit AS (SELECT page_id, url, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM (SELECT DISTINCT page_id, url, host, path FROM spelt) s JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, url)
SELECT s.page_id, host, path, f.rule, coalesce(f.v, CASE WHEN n.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, n.canonical IS NOT NULL AS listed
FROM spelt s LEFT JOIN fit f ON s.page_id IS NOT DISTINCT FROM f.page_id AND s.url IS NOT DISTINCT FROM f.url LEFT JOIN seen n ON s.canonical = n.canonical
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_cnn": op1_byte_cnn,
    "op2_tool_calls": op2_tool_calls,
    "op3_pfair_mix": op3_pfair_mix,
    "op4_multiset_hash": op4_multiset_hash,
    "op5_token_counts": op5_token_counts,
    "op6_importance": op6_importance,
    "op7_decontaminate": op7_decontaminate,
    "op8_brown_lm": op8_brown_lm,
    "op9_simhash_golay": op9_simhash_golay,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_collocations": op12_collocations,
    "op13_url_filter": op13_url_filter,
}

#: Earliest deadline first, slot by slot, over the block counts.
PFAIR_SQL = """
WITH RECURSIVE
rows_ AS (SELECT *, coalesce(source, '') AS s, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)) - 1 AS r FROM documents),
weights AS (SELECT s, (count(*) + 7) // 8 AS blocks, 1 + CAST('0x' || substr(md5(s), 1, 6) AS BIGINT) % 9 AS m FROM rows_ GROUP BY s),
steps AS (
  SELECT CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS begin_, 0 AS phase, 0 AS at_phase, CAST(NULL AS VARCHAR) AS pick,
    (SELECT list(struct_pack(s := s, m := CAST(m AS BIGINT), togo := CAST(blocks AS BIGINT), done := CAST(0 AS BIGINT)) ORDER BY s) FROM weights) AS state
  UNION ALL
  SELECT t + 1, CASE WHEN over THEN t + 1 ELSE begin_ END, CASE WHEN over THEN phase + 1 ELSE phase END, phase, pick,
    list_transform(state, lambda x: struct_pack(s := x.s, m := x.m, togo := x.togo - CASE WHEN x.s = pick THEN 1 ELSE 0 END, done := CASE WHEN over THEN 0 WHEN x.s = pick THEN x.done + 1 ELSE x.done END))
  FROM (
    SELECT t, begin_, phase, state, pick, list_filter(state, lambda x: x.s = pick)[1].togo = 1 AS over FROM (
      SELECT t, begin_, phase, state, list_sort(list_transform(list_filter(state, lambda x: x.togo > 0 AND x.done * total // x.m <= t - begin_), lambda x: struct_pack(d := ((x.done + 1) * total + x.m - 1) // x.m, s := x.s)))[1].s AS pick FROM (
        SELECT t, begin_, phase, state, CAST(list_sum(list_transform(state, lambda x: CASE WHEN x.togo > 0 THEN x.m ELSE 0 END)) AS BIGINT) AS total FROM steps) a WHERE total > 0) b) c
),
slots AS (SELECT t - 1 AS slot, at_phase, pick AS s, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS block FROM steps WHERE pick IS NOT NULL)
SELECT doc_id, text, lang, source, n_chars, at_phase AS mix_phase, slot AS mix_block, row_number() OVER (ORDER BY slot, r) - 1 AS mix_position FROM rows_ JOIN slots ON rows_.s = slots.s AND rows_.r // 8 = slots.block
"""

#: All windows of all texts, joined with the items' windows of the same length.
CONTAMINATION_SQL = """
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
found AS (SELECT g.doc_id, g.i, g.n, w.item_id FROM grams g JOIN windows w ON g.n = w.n AND g.gram = w.gram),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op2_tool_calls": TOOL_CALLS_SQL,
    "op3_pfair_mix": PFAIR_SQL,
    "op7_decontaminate": CONTAMINATION_SQL,
    "op11_filter_audit": FILTER_AUDIT_SQL,
    "op12_collocations": COLLOCATIONS_SQL,
    "op13_url_filter": URL_FILTER_SQL,
}
