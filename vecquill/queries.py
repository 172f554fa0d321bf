"""The driver's queries for the core operators, with their SQL.

All run over the whole ``embeddings`` table (or the tables of requests and
queries); those of the engine build a real index in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import VectorEngine
from .functions.checks import bad_rows, repeated_ids, valid
from .functions.distance import dot, l2_sqr
from .operators import ann
from .operators.knn import all_knn, knn, knn_within, nearest_one
from .shared import ints, matrix, scratch
from .sources import files
from .streaming.upserts import stream_into


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"))


def ten(rows: DataFrame) -> DataFrame:
    """The stated query set: ids 0 to 9."""
    return rows.where("idx < 10").select(F.col("idx").alias("qid"), F.col("vec").alias("q"))


def hundredth(rows: DataFrame) -> DataFrame:
    """Every row whose id is divisible by 100, for queries without SQL; the
    SQL of the others names the first ten."""
    return rows.where("idx % 100 = 0").select(F.col("idx").alias("qid"), F.col("vec").alias("q"))


def _one(rows: DataFrame, idx: int = 0) -> np.ndarray:
    return np.array(rows.where(F.col("idx") == idx).first().vec, np.float32)


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("qid", "rank", F.col("idx").alias("vec_id"), F.round("dist", 6).alias("dist"))


def _pairs(spark, sf_dir, each) -> DataFrame:
    x = embeddings(spark, sf_dir)
    y = x.select((F.col("idx") - 1).alias("idx"), F.col("vec").alias("next"))
    return x.join(y, "idx").select(F.col("idx").alias("vec_id"), F.round(each("vec", "next"), 6).alias("value"))


def l2_sqr_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir, l2_sqr)


def dot_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir, dot)


def l2_mat_vec(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    return x.select(F.col("idx").alias("vec_id"), F.round(l2_sqr("vec", _one(x)), 6).alias("value"))


def dot_mat_vec(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    return x.select(F.col("idx").alias("vec_id"), F.round(dot("vec", _one(x)), 6).alias("value"))


def brute_knn_batch(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    return _rounded(knn(x, ten(x), 10))


def all_knn_10(spark, sf_dir):
    return _rounded(all_knn(embeddings(spark, sf_dir), 10))


def search_single(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    return nearest_one(x, _one(x), 10).select(F.col("idx").alias("vec_id"), F.round("dist", 6).alias("dist"))


def search_k_gt_n(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    return _rounded(knn(x, ten(x).where("qid = 0"), x.count() + 5))


def logged_search(spark, sf_dir):
    """Every usable logged query against its whole collection, at its own k,
    live rows being the requests' first deliveries."""
    q = _table(spark, sf_dir, "search_queries").where(F.col("index_name").isNotNull() & valid("q", 32)).select("qid", F.col("index_name").alias("c"), "q", "k")
    x = _table(spark, sf_dir, "ingest_requests").where(F.col("index_name").isNotNull() & valid("vector", 32)).select(F.col("req_id").alias("idx"), F.col("index_name").alias("c"), F.col("vector").alias("vec")).dropDuplicates(["idx"])
    found = knn_within(x, q, "c", int(q.agg(F.max("k")).first()[0] or 1))
    w = Window.partitionBy("qid").orderBy("dist", "idx")
    out = found.join(q.select("qid", "k").distinct(), "qid").withColumn("rank", F.row_number().over(w).cast("bigint") - 1)
    return out.where("rank < k").select("qid", "rank", F.col("idx").alias("req_id"), F.round("dist", 6).alias("dist"))


# engine


def _path(spark: SparkSession) -> str:
    return scratch(spark, "index")


def _rows(x: DataFrame) -> DataFrame:
    return x.select(F.format_string("%08d", "idx").alias("external_id"), "vec")


def _engine(spark, x: DataFrame, **options) -> VectorEngine:
    e = VectorEngine(spark, _path(spark), 64, **options)
    e.write(_rows(x), "build")
    return e


def _answers(e: VectorEngine, x: DataFrame, k: int = 10) -> DataFrame:
    return e.search_batch(ten(x), k).select("qid", "rank", "external_id", F.round("distance", 6).alias("dist"))


def _live(e: VectorEngine) -> DataFrame:
    return e.rows().select("external_id", F.round(F.col("vec")[0].cast("double"), 6).alias("first"))


def search_main_delta(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    e = _engine(spark, x.where("idx < 400"))
    e.write(_rows(x.where("idx >= 400")), "insert")
    return _answers(e, x)


def search_after_delete(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    e = _engine(spark, x)
    e.delete(_rows(x.where("idx % 5 = 0")))
    return _answers(e, x)


def search_after_delete_all(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    e = _engine(spark, x)
    e.delete(_rows(x))
    return _answers(e, x)


def _upserted(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    new = x.where("idx >= 100 and idx < 150").select((F.col("idx") - 100).alias("idx"), "vec")
    e = _engine(spark, x)
    e.write(_rows(new), "upsert")
    return e, x


def search_after_upsert(spark, sf_dir):
    return _answers(*_upserted(spark, sf_dir))


def delete_counts(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    e = _engine(spark, x)
    n, _ = e.delete(_rows(x.where("idx % 5 = 0")))
    again, _ = e.delete(_rows(x.where("idx % 10 = 0")))
    return spark.createDataFrame([(n, again, e.live_count(), e.deletes_since_build())], "deleted bigint, again bigint, live bigint, deletes bigint")


def delete_not_found(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    e = _engine(spark, x)
    asked = _rows(x.where("idx < 3")).select("external_id").unionByName(x.where("idx < 3").select(F.concat(F.lit("missing_"), F.col("idx").cast("string")).alias("external_id")))
    return e.delete(asked)[1]


def live_rows(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    e = _engine(spark, x)
    e.delete(_rows(x.where("idx % 5 = 0")))
    return _live(e)


def compact_rows(spark, sf_dir):
    e, x = _upserted(spark, sf_dir)
    e.delete(_rows(x.where("idx % 5 = 0")))
    e.rebuild_compact()
    return _live(e)


def optimize_rows(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    e = _engine(spark, x.where("idx < 400"))
    e.write(_rows(x.where("idx >= 400")), "insert")
    e.optimize_graph()
    return _live(e)


def search_wide_build(spark, sf_dir):
    """An index built by more tasks than 2**10, then inserted into."""
    x = embeddings(spark, sf_dir)
    e = VectorEngine(spark, _path(spark), 64)
    e.write(_rows(x.where("idx % 2 = 0").repartition(1030, "idx")), "build")
    e.write(_rows(x.where("idx % 2 = 1")), "insert")
    return _answers(e, x)


def row_calls(spark, sf_dir):
    """Every row ingested by a call of its own."""
    x = embeddings(spark, sf_dir).toArrow()
    e = VectorEngine(spark, _path(spark), 64)
    e.init("build")
    for i, v in zip(ints(x.column(0)).tolist(), matrix(x.column(1))):
        e.ingest(f"{i:08d}", v)
    e.finalize()
    return _live(e)


def _sizes(e: VectorEngine) -> DataFrame:
    return e.spark.createDataFrame([(e.main_size, e.delta_size)], "main bigint, delta bigint")


def finalize_optimized(spark, sf_dir):
    """An insert above the ratio is merged at once, one below it is not."""
    x = embeddings(spark, sf_dir)
    e = _engine(spark, x.where("idx % 20 <> 0"))
    e.write(_rows(x.where("idx % 20 = 0")), "insert", optimize=True)
    small = _sizes(e)
    e = _engine(spark, x.where("idx % 5 <> 0"))
    e.write(_rows(x.where("idx % 5 = 0")), "insert", optimize=True)
    return small.unionByName(_sizes(e))


def delta_promoted(spark, sf_dir):
    """The delta becomes main when no row of main is live."""
    x = embeddings(spark, sf_dir)
    e = _engine(spark, x.where("idx % 5 <> 0"))
    e.write(_rows(x.where("idx % 5 = 0")), "insert")
    e.delete(_rows(x.where("idx % 5 <> 0")))
    return _sizes(e)


def internal_ids(spark, sf_dir):
    """The row numbers of an index built in the order of the ids."""
    x = embeddings(spark, sf_dir)
    return _engine(spark, x.coalesce(1).sortWithinPartitions("idx")).internal()


def answers_as_json(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    return files.answers_json(_engine(spark, x).search_batch(hundredth(x), 10))


def needs_rebuild_ratio(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    e = _engine(spark, x)
    fresh = e.needs_rebuild()
    e.delete(_rows(x.where("idx % 5 = 0")))
    return spark.createDataFrame([(fresh, e.needs_rebuild())], "fresh boolean, after boolean")


def invalid_vectors(spark, sf_dir):
    """Rows that ingest refuses among all requests, by reason."""
    x = _table(spark, sf_dir, "ingest_requests").select("req_id", F.coalesce("external_id", F.lit("")).alias("external_id"), F.col("vector").alias("vec"))
    return bad_rows(x, 32).groupBy("reason").agg(F.countDistinct("req_id").alias("n"))


def duplicate_ids(spark, sf_dir):
    """Ids that a build of each collection would refuse."""
    x = _table(spark, sf_dir, "ingest_requests").where("index_name is not null and external_id is not null").select("index_name", "external_id")
    return repeated_ids(x, "index_name", "external_id")


def raw_file_roundtrip(spark, sf_dir):
    x = embeddings(spark, sf_dir).orderBy("idx").toArrow()
    path = _path(spark)
    files.write_bytes(spark, path, matrix(x.column(1)).astype("<f4").tobytes())
    back = files.raw_vectors(spark, path, 64, [str(i) for i in ints(x.column(0)).tolist()])
    return _ends(back)


def _ends(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("external_id").cast("bigint").alias("vec_id"), F.round(F.col("vec")[0].cast("double"), 6).alias("first"), F.round(F.col("vec")[63].cast("double"), 6).alias("last"))


def fixed_width_roundtrip(spark, sf_dir):
    x = embeddings(spark, sf_dir).orderBy("idx").toArrow()
    path = _path(spark)
    files.write_bytes(spark, path, files.encode_rows(zip(ints(x.column(0)).tolist(), matrix(x.column(1)))))
    return _ends(files.fixed_width(spark, path, 64))


def json_rows(spark, sf_dir):
    x = embeddings(spark, sf_dir).select(F.col("idx").cast("string").alias("external_id"), "vec")
    return _ends(files.json_rows(files.to_json_rows(x, "e")).where("problem is null"))


def ivf_search(spark, sf_dir):
    """The table's vectors have no clusters, so 0.9 of the neighbours need most cells."""
    x = embeddings(spark, sf_dir)
    q, cells = hundredth(x), ann.Cells.write(x, _path(spark), 16)
    blocks = q.count() // 32768 + 1
    found = [cells.search(q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b), 10, 11) for b in range(blocks)]
    return _rounded(reduce(DataFrame.unionByName, found))


def _trained(spark, sf_dir) -> tuple[VectorEngine, DataFrame]:
    """A trained index with a delta and deletions."""
    x = embeddings(spark, sf_dir)
    e = _engine(spark, x.where("idx % 4 <> 1"))
    e.train(16)
    e.write(_rows(x.where("idx % 4 = 1")), "insert")
    e.delete(_rows(x.where("idx % 5 = 0")))
    return e, x


def search_all_cells(spark, sf_dir):
    """With all cells probed the approximate search is exact."""
    e, x = _trained(spark, sf_dir)
    return e.search_batch(ten(x), 10, efs=1 << 30).select("qid", "rank", "external_id", F.round("distance", 6).alias("dist"))


def search_recall(spark, sf_dir):
    """Whether the default ``efs`` finds 0.9 of the exact neighbours, in a
    trained index with a delta and deletions."""
    e, x = _trained(spark, sf_dir)
    q = hundredth(x)
    truth, found = (e.search_batch(q, 10, efs=efs).select("qid", "external_id") for efs in (None, 64))
    hit = truth.join(found.withColumn("hit", F.lit(1)), ["qid", "external_id"], "left")
    return hit.agg(F.countDistinct("qid").alias("queries"), F.count(F.lit(1)).alias("neighbours"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


def lsh_search(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    return _rounded(ann.hashed(x, hundredth(x), 10, 1.6))


def _collection_key(name: Column, external: Column) -> Column:
    """One id for both; the name's length ahead keeps any two apart."""
    return F.concat(F.length(name).cast("string"), F.lit(":"), name, external)


def stream_upserts_all(spark, sf_dir):
    """The requests of all collections as a stream of upserts."""
    source = spark.read.parquet(f"{sf_dir}/ingest_requests.parquet").schema
    rows = spark.readStream.schema(source).option("maxFilesPerTrigger", 8).option("pathGlobFilter", "*.parquet").parquet(_folder(sf_dir))
    rows = rows.where("req_id is not null and index_name is not null").where(F.col("external_id").isNotNull() & valid("vector", 32))
    rows = rows.select(_collection_key(F.col("index_name"), F.col("external_id")).alias("external_id"), F.col("vector").alias("vec"), "req_id")
    e = VectorEngine(spark, _path(spark), 32)
    stream_into(rows, e, _path(spark), order="req_id", once=True).awaitTermination()
    size = F.substring_index("external_id", ":", 1)
    start, n = F.length(size) + 2, size.cast("int")
    return _live(e).select(F.col("external_id").substr(start, n).alias("index_name"), F.col("external_id").substr(start + n, F.length("external_id")).alias("external_id"), "first")


def stream_upserts(spark, sf_dir):
    """One collection of the stream of all."""
    return stream_upserts_all(spark, sf_dir).where("index_name = 'catalog_main'").select("external_id", "first")


def _folder(sf_dir: str) -> str:
    """A file source wants a folder or a glob, not a single file's name."""
    return f"{sf_dir}/ingest_requests.parque[t]"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        l2_sqr_pairs, dot_pairs, l2_mat_vec, dot_mat_vec, brute_knn_batch, all_knn_10, search_single, search_k_gt_n, logged_search,
        search_main_delta, search_after_delete, search_after_delete_all, search_after_upsert, delete_counts, delete_not_found, live_rows,
        compact_rows, optimize_rows, search_wide_build, row_calls, finalize_optimized, delta_promoted, internal_ids, answers_as_json, needs_rebuild_ratio, invalid_vectors, duplicate_ids, raw_file_roundtrip, fixed_width_roundtrip, json_rows,
        ivf_search, search_all_cells, search_recall, lsh_search, stream_upserts, stream_upserts_all,
    )
}

_L2 = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)))"
_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _search_sql(rows: str, k: int = 10) -> str:
    """Top-k of the first ten vectors over rows (external_id, embedding, ord)."""
    return f"""WITH x AS ({rows}), d AS (SELECT b.vec_id AS qid, a.external_id, a.ord, {_L2} AS d FROM x a, embeddings b WHERE b.vec_id < 10),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, ord) - 1 AS rank FROM d)
SELECT qid, rank, external_id, round(d, 6) AS dist FROM r WHERE rank < {k}"""


_KNN = f"""WITH d AS (SELECT b.vec_id AS qid, a.vec_id, {_L2} AS d FROM embeddings a, embeddings b WHERE %s),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) - 1 AS rank FROM d)
SELECT qid, rank, vec_id, round(d, 6) AS dist FROM r WHERE rank < %s"""
_ID = "lpad(vec_id::VARCHAR, 8, '0')"
_ALL = f"SELECT {_ID} AS external_id, embedding, vec_id AS ord FROM embeddings"
_UPSERTED = f"""SELECT {_ID} AS external_id, embedding, vec_id AS ord FROM embeddings WHERE vec_id >= 50
UNION ALL SELECT lpad((vec_id - 100)::VARCHAR, 8, '0'), embedding, 1000000 + vec_id FROM embeddings WHERE vec_id >= 100 AND vec_id < 150"""
_FIRST = "round(embedding[1]::DOUBLE, 6) AS first"
_ENDS = "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last FROM embeddings"
_OK = "len({0}) = 32 AND len(list_filter({0}, lambda x: x IS NOT NULL AND NOT isnan(x) AND abs(x) <= 1e16)) = 32"

SQL: dict[str, str] = {
    "l2_sqr_pairs": f"SELECT a.vec_id, round({_L2}, 6) AS value FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "dot_pairs": f"SELECT a.vec_id, round({_DOT}, 6) AS value FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "l2_mat_vec": f"SELECT a.vec_id, round({_L2}, 6) AS value FROM embeddings a JOIN embeddings b ON b.vec_id = 0",
    "dot_mat_vec": f"SELECT a.vec_id, round({_DOT}, 6) AS value FROM embeddings a JOIN embeddings b ON b.vec_id = 0",
    "brute_knn_batch": _KNN % ("b.vec_id < 10", 10),
    "all_knn_10": _KNN % ("a.vec_id <> b.vec_id", 10),
    "search_single": f"SELECT a.vec_id, round({_L2}, 6) AS dist FROM embeddings a JOIN embeddings b ON b.vec_id = 0 ORDER BY {_L2}, a.vec_id LIMIT 10",
    "search_k_gt_n": _KNN % ("b.vec_id = 0", 1000000),
    "logged_search": f"""WITH x AS (SELECT req_id, any_value(index_name) AS c, any_value(vector) AS embedding FROM ingest_requests WHERE index_name IS NOT NULL AND {_OK.format('vector')} GROUP BY req_id),
q AS (SELECT DISTINCT qid, index_name AS c, q AS embedding, k FROM search_queries WHERE index_name IS NOT NULL AND {_OK.format('q')}),
d AS (SELECT b.qid, b.k, a.req_id, {_L2} AS d FROM x a JOIN q b ON a.c = b.c),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, req_id) - 1 AS rank FROM d)
SELECT qid, rank, req_id, round(d, 6) AS dist FROM r WHERE rank < k""",
    "search_main_delta": _search_sql(_ALL),
    "search_all_cells": _search_sql(_ALL + " WHERE vec_id % 5 <> 0"),
    "search_recall": "SELECT count(*) AS queries, 10 * count(*) AS neighbours, true AS enough FROM embeddings WHERE vec_id % 100 = 0",
    "search_after_delete": _search_sql(_ALL + " WHERE vec_id % 5 <> 0"),
    "search_after_delete_all": f"SELECT * FROM ({_search_sql(_ALL)}) WHERE false",
    "search_wide_build": _search_sql(f"SELECT {_ID} AS external_id, embedding, vec_id AS ord FROM embeddings"),
    "row_calls": f"SELECT {_ID} AS external_id, {_FIRST} FROM embeddings",
    "finalize_optimized": """SELECT count(*) FILTER (vec_id % 20 <> 0) AS main, count(*) FILTER (vec_id % 20 = 0) AS delta FROM embeddings
UNION ALL SELECT count(*), 0 FROM embeddings""",
    "delta_promoted": "SELECT count(*) FILTER (vec_id % 5 = 0) AS main, 0::BIGINT AS delta FROM embeddings",
    "internal_ids": f"SELECT vec_id AS idx, {_ID} AS external_id FROM embeddings",
    "answers_as_json": f"""WITH d AS (SELECT b.vec_id AS qid, a.vec_id, {_L2} AS d FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM d)
SELECT qid, to_json(list({_ID} ORDER BY rank))::VARCHAR AS value FROM r WHERE rank <= 10 GROUP BY qid""",
    "search_after_upsert": _search_sql(_UPSERTED),
    "delete_counts": """SELECT (count(*) FILTER (vec_id % 5 = 0))::BIGINT AS deleted, 0::BIGINT AS again, (count(*) FILTER (vec_id % 5 <> 0))::BIGINT AS live,
(count(*) FILTER (vec_id % 5 = 0))::BIGINT AS deletes FROM embeddings""",
    "delete_not_found": "SELECT 'missing_' || vec_id::VARCHAR AS external_id FROM embeddings WHERE vec_id < 3",
    "live_rows": f"SELECT {_ID} AS external_id, {_FIRST} FROM embeddings WHERE vec_id % 5 <> 0",
    "compact_rows": f"SELECT external_id, {_FIRST} FROM ({_UPSERTED}) WHERE external_id::BIGINT % 5 <> 0",
    "optimize_rows": f"SELECT {_ID} AS external_id, {_FIRST} FROM embeddings",
    "needs_rebuild_ratio": "SELECT false AS fresh, count(*) FILTER (vec_id % 5 = 0) >= 0.1 * count(*) FILTER (vec_id % 5 <> 0) AS after FROM embeddings",
    "invalid_vectors": f"""SELECT CASE WHEN vector IS NULL OR len(vector) <> 32 THEN 'dimension mismatch' ELSE 'NaN/Inf' END AS reason, count(DISTINCT req_id) AS n
FROM ingest_requests WHERE vector IS NULL OR NOT ({_OK.format('vector')}) GROUP BY 1""",
    "duplicate_ids": "SELECT index_name, external_id, count(*) AS n FROM ingest_requests WHERE index_name IS NOT NULL AND external_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "raw_file_roundtrip": _ENDS,
    "fixed_width_roundtrip": _ENDS,
    "json_rows": _ENDS,
    "stream_upserts": f"""SELECT external_id, round(arg_max(vector, req_id)[1]::DOUBLE, 6) AS first FROM ingest_requests
WHERE index_name = 'catalog_main' AND external_id IS NOT NULL AND {_OK.format('vector')} GROUP BY external_id""",
    "stream_upserts_all": f"""SELECT index_name, external_id, round(arg_max(vector, req_id)[1]::DOUBLE, 6) AS first FROM ingest_requests
WHERE index_name IS NOT NULL AND external_id IS NOT NULL AND {_OK.format('vector')} GROUP BY index_name, external_id""",
}
