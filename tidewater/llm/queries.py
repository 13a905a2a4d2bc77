"""The registered queries of the numbered operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import (cross_entropy, decontaminate, divergence, jaccard_join, lexical, licences, line_rules, mixing, sharding, templates, token_orc,
                           toxicity, url_list)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the generated tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdicts; the host of a document is its source."""
    return line_rules.line_rules(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (
  SELECT r, unnest(range(1, len(w) - 3)) AS p,
         unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM w WHERE len(w) >= 5),
again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM again) GROUP BY r),
lines AS (
  SELECT r, source, t, l, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) AS k
  FROM (SELECT r, source, t, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY r),
of_host AS (SELECT source, count(*) AS n FROM d GROUP BY source),
bad AS (
  SELECT x.source, x.k FROM (SELECT source, k, count(DISTINCT r) AS c FROM lines GROUP BY source, k) x
  JOIN of_host h ON x.source IS NOT DISTINCT FROM h.source WHERE c >= 10 AND (c >= 10000 OR c * 100 > h.n * 5)),
lost AS (
  SELECT r, count(*) AS n, sum(len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))) AS words
  FROM lines JOIN bad ON lines.source IS NOT DISTINCT FROM bad.source AND lines.k = bad.k GROUP BY r),
f AS (
  SELECT d.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lost.n, 0)::BIGINT AS n_removed_lines, coalesce(lost.words, 0)::BIGINT AS n_removed_words
  FROM d JOIN w USING (r) LEFT JOIN covered USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_removed_words * 100 <= n_words * 70 AS kept,
       n_removed_lines, n_removed_words
FROM f
"""


def op2_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards of nearly equal bytes, as ranges of doc_id."""
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 40).drop("range_id")


OP2_SQL = """
WITH bits AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
         xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, bits),
p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS start, sum(size) OVER () AS total FROM d),
s AS (SELECT *, least(39, (2 * start + size) * 40 // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM s
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labels that aren't held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents within a tenth of edits."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def captures(pages: DataFrame) -> DataFrame:
    """Pages with a time of fetching, which the table hasn't: a day and an hour of 2024 by the id."""
    day, hour = F.col("page_id") * 13 % 365, F.col("page_id") % 24
    return pages.select("page_id", "url", F.timestamp_seconds(1704067200 + day * 86400 + hour * 3600).alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated changes for a part of the hosts, domains and URLs of the pages themselves."""
    at = lambda day: F.timestamp_seconds(1704067200 + day * 86400)
    host = pages.select(url_list.host_of(F.col("url")).alias("key"), "page_id").where("key <> ''").groupBy("key").agg(F.min("page_id").alias("m"))
    domain = host.select(F.regexp_extract("key", "[^.]+[.][^.]+$", 0).alias("key"), "m").where("key <> ''").groupBy("key").agg(F.min("m").alias("m"))
    url = pages.where("page_id % 50 = 7").select(url_list.key_of(F.col("url")).alias("key"), F.col("page_id").alias("m"))
    changes = lambda *of: F.explode(F.array(*(F.struct(F.lit(a).alias("action"), at(d).alias("at")) for a, d in of)))
    m = F.col("m")
    made = [
        (host.where("m % 3 = 0"), "host", changes(("add", m % 200), ("remove", m % 200 + 60), ("add", m % 200 + 120))),
        (domain.where("m % 4 = 1"), "domain", changes(("add", m * 7 % 300), ("remove", m * 7 % 300 + 45))),
        (url, "url", changes(("add", m % 365), ("remove", m % 365 + 200)))]
    out = None
    for rows, kind, change in made:
        part = rows.select(F.lit(kind).alias("kind"), "key", change.alias("c")).select("kind", "key", "c.action", "c.at")
        out = part if out is None else out.union(part)
    return out


def op5_temporal_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list entries in force when it was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_list.judge(captures(pages), list_entries(pages)).withColumns({c: F.unix_timestamp(c) for c in ("fetched_at", "listed_at")})


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, trim(coalesce(url, '')) AS u, 1704067200 + page_id * 13 % 365 * 86400 + page_id % 24 * 3600 AS fetched_at FROM pages),
c AS (
  SELECT page_id, fetched_at, regexp_replace(regexp_replace(regexp_extract(lower(u), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.+$', ''), '^www\.', '') AS host,
         regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^#]*)', 1) AS rest FROM p),
k AS (SELECT *, regexp_replace(host || rest, '/+$', '') AS key FROM c),
hosts AS (SELECT host AS key, min(page_id) AS m FROM k WHERE host <> '' GROUP BY host),
domains AS (SELECT regexp_extract(key, '[^.]+[.][^.]+$') AS key, min(m) AS m FROM hosts GROUP BY 1 HAVING regexp_extract(key, '[^.]+[.][^.]+$') <> ''),
changes AS (
  SELECT 1 AS kind, key, unnest(['add', 'remove', 'add']) AS action, unnest([m % 200, m % 200 + 60, m % 200 + 120]) AS day FROM hosts WHERE m % 3 = 0
  UNION ALL SELECT 2, key, unnest(['add', 'remove']), unnest([m * 7 % 300, m * 7 % 300 + 45]) FROM domains WHERE m % 4 = 1
  UNION ALL SELECT 0, key, unnest(['add', 'remove']), unnest([page_id % 365, page_id % 365 + 200]) FROM k WHERE page_id % 50 = 7 AND key <> ''),
moments AS (SELECT kind, key, 1704067200 + day * 86400 AS since, max(action) AS action FROM changes GROUP BY ALL),
spans AS (SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY kind, key ORDER BY since) AS until FROM moments) WHERE action = 'add'),
asked AS (
  SELECT page_id, fetched_at, 0 AS kind, key FROM k WHERE host <> ''
  UNION ALL SELECT page_id, fetched_at, 1, host FROM k WHERE host <> ''
  UNION ALL SELECT page_id, fetched_at, 2, array_to_string(string_split(host, '.')[i:], '.')
    FROM (SELECT *, unnest(range(1, greatest(2, len(string_split(host, '.'))))) AS i FROM k WHERE host <> '')),
hits AS (
  SELECT page_id, asked.kind, since FROM asked JOIN spans ON asked.kind = spans.kind AND asked.key = spans.key
  WHERE since <= fetched_at AND (until IS NULL OR fetched_at < until)),
best AS (SELECT page_id, min(kind) AS kind, min_by(since, kind * 100000000000 + since) AS since, count(DISTINCT kind) AS n FROM hits GROUP BY page_id)
SELECT k.page_id, host, fetched_at::BIGINT AS fetched_at, best.kind IS NOT NULL AS blocked,
       CASE best.kind WHEN 0 THEN 'url' WHEN 1 THEN 'host' WHEN 2 THEN 'domain' END AS listed_as,
       since::BIGINT AS listed_at, coalesce(n, 0)::INT AS n_kinds
FROM k LEFT JOIN best USING (page_id)
"""


def op6_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of all documents under models of the documents labelled as good and of all others."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to ORC and read back."""
    import public_tokenizers

    return token_orc.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("part")


#: Target weights of the first two levels; the others are even.
WEIGHTS = {("domain0",): 3, ("domain1",): 1, ("domain2",): 2, ("domain3",): 1, ("domain0", "en"): 2, ("domain1", "de"): 3}


def op8_hierarchical_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn for a budget of 80 per cent of all tokens, in up to two epochs."""
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.by_source(), WEIGHTS, 0.8, epochs=2)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a similarity of 0.8 or more."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).drop("n_links")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

def op10_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that the sentences of each document name."""
    return licences.scan(table(spark, sf_dir, "documents"))


def _licence_sql() -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    stems = licences.STEMS.replace(" ", "[^a-z0-9]+")
    keys = ", ".join(quoted(k) for k in licences.known())
    names = ", ".join(quoted(v) for v in licences.known().values())
    steps, last = "", "s"
    for k, (name, run) in enumerate(licences.RULES):
        pattern = quoted("".join(f"<{i}>" for i in run))
        steps += f""",
r{k} AS (SELECT doc_id, ids, replace(seq, {pattern}, '|') AS seq,
  CASE WHEN contains(seq, {pattern}) AND NOT list_contains(found, {quoted(name)}) THEN list_append(found, {quoted(name)}) ELSE found END AS found FROM {last})"""
        last = f"r{k}"
    norm = lambda v: f"trim(regexp_replace(lower({v}), '[^a-z0-9]+', ' ', 'g'))"
    look = lambda v: f"CASE WHEN regexp_matches({norm(v)}, '{licences.STEMS}') THEN coalesce(known[{norm(v)}], CASE WHEN regexp_matches({norm(v)}, '{licences.TELLING}') THEN 'unknown' END) END"
    return rf"""
WITH k AS (SELECT map([{keys}], [{names}]) AS known),
t AS (
  SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), '{stems}') THEN string_split(regexp_replace(regexp_replace(regexp_replace(text, '{licences.MARKS}', '', 'g'), '([.!?:;])[ 	
]+', '' || chr(1), 'g'),
    '
[ 	
]*
[ 	
]*', chr(1), 'g'), chr(1)) ELSE [] END AS parts FROM documents),
i AS (
  SELECT doc_id, flatten(list_transform(list_filter(parts, lambda p: regexp_matches(lower(p), '{stems}')), lambda p:
    CASE WHEN coalesce({look("p")}, 'unknown') <> 'unknown' THEN [{look("p")}]
    ELSE list_filter(list_transform(string_split(p, chr(10)), lambda l: {look("l")}), lambda v: v IS NOT NULL) END)) AS ids FROM t, k),
s AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda v: '<' || v || '>'), '') AS seq, []::VARCHAR[] AS found FROM i){steps}
SELECT doc_id, array_to_string(found, ',') AS licences, array_to_string(ids, ',') AS sentences,
       len(list_filter(ids, lambda v: v <> 'unknown'))::INT AS n_known, len(list_filter(ids, lambda v: v = 'unknown'))::INT AS n_unknown
FROM {last}
"""


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda v: translate(v, '{UPPER}', '{LOWER}')) AS t FROM documents),
a AS (SELECT count(*)::BIGINT AS big_n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
i AS (
  SELECT DISTINCT item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda v: translate(v, '{UPPER}', '{LOWER}'))) AS term FROM benchmark),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), a),
s AS (
  SELECT i.item_id, d.r, d.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(t) * big_n) // l))))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN tf USING (term) JOIN d USING (r), a GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the words that tell a source."""
    return divergence.divergences(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda v: translate(v, '{UPPER}', '{LOWER}')) AS t FROM documents),
w AS (SELECT r, lang, source, unnest(t) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w WHERE (lang, term) IN (SELECT (lang, term) FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30) GROUP BY ALL),
c AS (SELECT w.lang, source, w.term, count(*)::HUGEINT AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS big_n FROM k GROUP BY lang),
g AS (SELECT x.lang, x.source, coalesce(sum(n), 0)::HUGEINT AS big_n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c ON x.lang = c.lang AND x.source = c.source GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.big_n + 5 * l.v) AS p,
         1 + (1000000000 * (k.n + 5)) // (l.big_n + 5 * l.v) AS q
  FROM g JOIN l ON g.lang = l.lang JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.f, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
x AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x) WHERE part = 'pair' OR rank <= 50
"""


def op13_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages, without what their sites repeat."""
    return templates.main_texts(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_line_frequency": op1_line_frequency,
    "op2_sampled_splitters": op2_sampled_splitters,
    "op3_toxicity": op3_toxicity,
    "op4_qgram_decontamination": op4_qgram_decontamination,
    "op5_temporal_list_join": op5_temporal_list_join,
    "op6_cross_entropy_difference": op6_cross_entropy_difference,
    "op7_token_orc": op7_token_orc,
    "op8_hierarchical_budget": op8_hierarchical_budget,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_licence_rules": op10_licence_rules,
    "op11_lexical_search": op11_lexical_search,
    "op12_source_divergence": op12_source_divergence,
    "op13_site_templates": op13_site_templates,
}
ORACLES: dict[str, str] = {
    "op1_line_frequency": OP1_SQL,
    "op2_sampled_splitters": OP2_SQL,
    "op5_temporal_list_join": OP5_SQL,
    "op9_jaccard_join": OP9_SQL,
    "op10_licence_rules": _licence_sql(),
    "op11_lexical_search": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
}
