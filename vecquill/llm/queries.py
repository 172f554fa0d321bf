"""The queries of the problems and their SQL; every query runs over its whole
tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import containers, cuckoo, diverse, history, leakage, onebit, pivots, spans
from .vectors import usable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def about(spark: SparkSession, sf_dir: str) -> int:
    """The number of request rows, usable or not, from the files' footers."""
    return table(spark, sf_dir, "ingest_requests").count()


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable(table(spark, sf_dir, "ingest_requests").select("req_id", "index_name", "external_id", "vector"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.seen_before(table(spark, sf_dir, "ingest_requests"), table(spark, sf_dir, "delete_requests"))


def p1_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.audit(table(spark, sf_dir, "ingest_requests"), table(spark, sf_dir, "delete_requests"))


def p1_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the audit SQL can know: the events; that each was either asked
    about or settled before; and that wrong answers are rare."""
    a = p1_audit(spark, sf_dir)
    return a.select("events", (F.col("repeats") + F.col("asked") == F.col("events")).alias("all_answered"), (F.col("wrong_rate") < 0.001).alias("few_wrong"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usable items of all batches: (id, collection, vector)."""
    rows = table(spark, sf_dir, "ingest_batches").select("batch_id", "index_name", F.explode("items").alias("item"))
    rows = rows.select("batch_id", "index_name", F.col("item.item_id").alias("id"), F.col("item.external_id").alias("external_id"), F.col("item.vector").alias("vector"))
    return usable(rows).withColumnRenamed("index_name", "collection")


def p2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each near repeat with its distance, and whether it is a full copy; the
    requests are accepted once, the batches checked as they arrive."""
    old = requests(spark, sf_dir).select(F.col("req_id").alias("id"), F.col("index_name").alias("collection"), "vector")
    new = items(spark, sf_dir).withColumnRenamed("batch_id", "batch")
    return history.replay(old, new, total=about(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_repeats(spark, sf_dir).select("id_a", "id_b")


def p3_members(spark: SparkSession, sf_dir: str, k: int = 64) -> DataFrame:
    """Every usable request with the representative that stands for it."""
    return diverse.members(requests(spark, sf_dir), k)


def p3_select(spark: SparkSession, sf_dir: str, k: int = 64) -> DataFrame:
    base = requests(spark, sf_dir)
    names = base.select("req_id", "external_id").dropDuplicates(["req_id"])
    return diverse.select(base, k).join(names, "req_id")


def p3_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can know of the selection: the records of each collection, all
    of which have a representative, and the representatives, each of which
    stands for itself."""
    own = F.count(F.when((F.col("req_id") == F.col("representative")) & (F.col("distance") == 0), 1))
    return p3_members(spark, sf_dir).groupBy("index_name").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("representative").alias("representatives"), own.alias("own"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.clusters(requests(spark, sf_dir), total=about(spark, sf_dir))


def p4_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.typical(requests(spark, sf_dir), total=about(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.pairs(onebit.neighbours(requests(spark, sf_dir)))


def p5_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours with external id, distance and rank from 0."""
    from pyspark.sql import Window

    base = requests(spark, sf_dir)
    names = base.select(F.col("req_id").alias("neighbour"), "external_id").dropDuplicates(["neighbour"])
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    found = onebit.neighbours(base).withColumn("rank", F.row_number().over(w).cast("bigint") - 1)
    return found.join(names, "neighbour").select(F.col("id").alias("req_id"), "rank", F.col("neighbour").alias("neighbour_id"), "external_id", F.round("distance", 6).alias("distance"))


def p5_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = requests(spark, sf_dir)
    return onebit.missed(base, onebit.neighbours(base))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return containers.pack(docs.select("doc_id", containers.tokens(F.col("text")).alias("size")), rows=docs.count())


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.split(packed(spark, sf_dir))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir)


def p6_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.report(packed(spark, sf_dir))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces without their containers: each text once, split only
    if it is larger than one."""
    return packed(spark, sf_dir).select("doc_id", "piece", "size")


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in containers, and containers above the capacity."""
    per = packed(spark, sf_dir).groupBy("container").agg(F.sum("size").alias("size"))
    return per.agg(F.sum("size").alias("tokens"), F.count(F.when(F.col("size") > containers.CAPACITY, 1)).alias("above"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items").select("item_id", "text"))


def p7_altered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with up to two edits as well."""
    return leakage.passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items").select("item_id", "text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.Shared(table(spark, sf_dir, "documents").select("doc_id", "text")).pairs()


def p8_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.Shared(table(spark, sf_dir, "documents").select("doc_id", "text")).amounts()


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs between the least rows of different texts."""
    return spans.Shared(table(spark, sf_dir, "documents").select("doc_id", "text")).class_pairs()


def p8_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stands for each row's text."""
    return spans.Shared(table(spark, sf_dir, "documents").select("doc_id", "text")).membership()


def p8_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long a shared stretch is, by doubling from 200 on."""
    return spans.longest(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_audit, p1_events, p2_found, p2_repeats, p3_members, p3_select, p3_covered, p4_found, p4_typical, p5_found, p5_results, p5_missed, p6_found, p6_containers, p6_filled, p6_pieces, p6_kept, p7_found, p7_altered, p8_found, p8_amounts, p8_classes, p8_members, p8_longest)
}

_USABLE = """SELECT req_id AS id, any_value(index_name) AS c, any_value(vector) AS v FROM ingest_requests
WHERE index_name IS NOT NULL AND len(vector) = 32 AND len(list_filter(vector, lambda x: x IS NOT NULL AND NOT isnan(x) AND abs(x) <= 1e16)) = 32
GROUP BY req_id"""
_ITEMS = """SELECT t.item.item_id AS id, any_value(t.index_name) AS c, any_value(t.item.vector) AS v
FROM (SELECT index_name, unnest(items) AS item FROM ingest_batches) t
WHERE t.index_name IS NOT NULL AND len(t.item.vector) = 32 AND len(list_filter(t.item.vector, lambda x: x IS NOT NULL AND NOT isnan(x) AND abs(x) <= 1e16)) = 32
GROUP BY t.item.item_id"""
_NEAR = "list_distance(a.v::DOUBLE[], b.v::DOUBLE[])"

SQL: dict[str, str] = {
    "p1_events": """SELECT (SELECT count(DISTINCT req_id) FROM ingest_requests WHERE index_name IS NOT NULL AND external_id <> '')
+ (SELECT count(*) FROM (SELECT DISTINCT req_id, pos FROM (SELECT req_id, index_name, unnest(external_ids) AS ext, generate_subscripts(external_ids, 1) AS pos FROM delete_requests)
WHERE index_name IS NOT NULL AND ext <> '')) AS events, true AS all_answered, true AS few_wrong""",
    "p1_found": """WITH f AS (SELECT index_name, external_id, min(req_id) AS first FROM ingest_requests WHERE index_name IS NOT NULL AND external_id <> '' GROUP BY ALL),
e AS (SELECT DISTINCT req_id, 0::BIGINT AS pos, index_name, external_id FROM ingest_requests
UNION ALL SELECT DISTINCT req_id, (generate_subscripts(external_ids, 1) - 1)::BIGINT, index_name, unnest(external_ids) FROM delete_requests)
SELECT e.req_id, e.pos FROM e JOIN f USING (index_name, external_id) WHERE f.first < e.req_id""",
    "p2_found": f"""WITH u AS ({_USABLE}), i AS ({_ITEMS}), w AS (SELECT * FROM u UNION ALL SELECT * FROM i)
SELECT a.id AS id_a, b.id AS id_b FROM w a JOIN i b ON a.c = b.c AND a.id < b.id AND {_NEAR} <= 0.06
WHERE list_sum(list_transform(range(1, 33), lambda k: (a.v[k]::DOUBLE - b.v[k]::DOUBLE) * (a.v[k]::DOUBLE - b.v[k]::DOUBLE))) <= 0.0025""",
    "p4_found": f"""WITH RECURSIVE u AS MATERIALIZED ({_USABLE}),
e AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM u a JOIN u b ON a.c = b.c AND a.id <> b.id AND {_NEAR} <= 1.0001
WHERE list_sum(list_transform(range(1, 33), lambda k: (a.v[k]::DOUBLE - b.v[k]::DOUBLE) * (a.v[k]::DOUBLE - b.v[k]::DOUBLE))) <= 1.0),
r AS (SELECT id AS x, id AS y FROM u UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x WHERE e.y > r.x),
m AS (SELECT y AS req_id, min(x) AS cluster_key FROM r GROUP BY y)
SELECT cluster_key, req_id FROM m WHERE cluster_key IN (SELECT cluster_key FROM m GROUP BY cluster_key HAVING count(*) >= 3)""",
    "p5_found": f"""WITH u AS ({_USABLE}),
d AS (SELECT a.id AS x, b.id AS y, list_sum(list_transform(range(1, 33), lambda k: (a.v[k]::DOUBLE - b.v[k]::DOUBLE) * (a.v[k]::DOUBLE - b.v[k]::DOUBLE))) AS d
FROM u a JOIN u b ON a.c = b.c AND a.id <> b.id AND {_NEAR} <= 1.0001),
n AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY d, y) AS k FROM d WHERE d <= 1.0)
SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM n WHERE k <= 5""",
    "p6_found": r"""SELECT DISTINCT doc_id FROM documents WHERE len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]')) > 2048""",
    "p6_pieces": r"""SELECT doc_id, piece::BIGINT AS piece, least(2048, n - 2048 * piece)::BIGINT AS size FROM
(SELECT doc_id, n, unnest(range(0, greatest(1, (n + 2047) // 2048))) AS piece FROM
(SELECT doc_id, coalesce(len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]')), 0)::BIGINT AS n FROM documents))""",
    "p6_kept": r"""SELECT sum(len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]')))::BIGINT AS tokens, 0::BIGINT AS above FROM documents""",
    "p3_covered": f"""SELECT c AS index_name, count(*) AS records, least(64, count(DISTINCT v)) AS representatives, least(64, count(DISTINCT v)) AS own FROM ({_USABLE}) GROUP BY c""",
    "p7_found": r"""WITH w AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM eval_items),
g AS (SELECT DISTINCT kind, id, array_to_string(list_slice(w, i, i + 9), ' ') AS g FROM (SELECT kind, id, w, unnest(range(1, len(w) - 8)) AS i FROM w WHERE len(w) >= 10))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i USING (g) WHERE d.kind = 'd' AND i.kind = 'i'""",
    "p8_found": """WITH g AS (SELECT DISTINCT doc_id, substring(text, i, 200) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM g a JOIN g b USING (g) WHERE a.doc_id < b.doc_id""",
    "p2_repeats": f"""WITH u AS ({_USABLE}), i AS ({_ITEMS}), w AS (SELECT * FROM u UNION ALL SELECT * FROM i),
p AS (SELECT a.id AS id_a, b.id AS id_b, list_sum(list_transform(range(1, 33), lambda k: (a.v[k]::DOUBLE - b.v[k]::DOUBLE) * (a.v[k]::DOUBLE - b.v[k]::DOUBLE))) AS d
FROM w a JOIN i b ON a.c = b.c AND a.id < b.id AND {_NEAR} <= 0.06)
SELECT id_a, id_b, round(d, 6) AS distance, d = 0 AS full_copy FROM p WHERE d <= 0.0025""",
    "p5_results": f"""WITH u AS ({_USABLE}),
d AS (SELECT a.id AS x, b.id AS y, list_sum(list_transform(range(1, 33), lambda k: (a.v[k]::DOUBLE - b.v[k]::DOUBLE) * (a.v[k]::DOUBLE - b.v[k]::DOUBLE))) AS d
FROM u a JOIN u b ON a.c = b.c AND a.id <> b.id AND {_NEAR} <= 1.0001),
n AS (SELECT x, y, d, row_number() OVER (PARTITION BY x ORDER BY d, y) - 1 AS rank FROM d WHERE d <= 1.0),
e AS (SELECT req_id, any_value(external_id) AS external_id FROM ingest_requests GROUP BY req_id)
SELECT x AS req_id, rank, y AS neighbour_id, external_id, round(d, 6) AS distance FROM n JOIN e ON e.req_id = y WHERE rank < 5""",
    "p8_classes": """WITH t AS (SELECT text, min(doc_id) AS doc_id FROM documents WHERE length(text) >= 200 GROUP BY text),
g AS (SELECT DISTINCT doc_id, substring(text, i, 200) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM t))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM g a JOIN g b USING (g) WHERE a.doc_id < b.doc_id""",
    "p8_members": "SELECT DISTINCT doc_id, min(doc_id) OVER (PARTITION BY text) AS representative FROM documents WHERE length(text) >= 200",
    "p8_longest": """WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200),
g AS (SELECT doc_id, n, hash(substring(text, i, n)) AS g FROM (SELECT doc_id, text, n, unnest(range(1, length(text) - n + 2)) AS i FROM t JOIN (SELECT 200 << unnest(range(0, 24)) AS n) ON length(text) >= n)),
s AS (SELECT n, g FROM g GROUP BY n, g HAVING min(doc_id) < max(doc_id))
SELECT doc_id, length(text)::BIGINT AS n_chars, max(n)::BIGINT AS shared FROM g JOIN s USING (n, g) JOIN t USING (doc_id) GROUP BY ALL""",
    "p8_amounts": """WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200),
g AS (SELECT doc_id, i, substring(text, i, 200) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM t)),
s AS (SELECT g FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM g JOIN s USING (g)),
a AS (SELECT doc_id, sum(least(200, coalesce(n - i, 200)))::BIGINT AS shared_chars FROM c GROUP BY doc_id),
k AS (SELECT text, (count(*) - 1)::BIGINT AS copies FROM t GROUP BY text)
SELECT doc_id, length(text)::BIGINT AS n_chars, shared_chars, copies FROM a JOIN t USING (doc_id) JOIN k USING (text)""",
}
