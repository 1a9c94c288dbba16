import os
import zlib

import duckdb
from fixtures import DOCS, SF, docs, rows, same, with_extra
from polyglint.llm import sharding
from polyglint.llm.queries import ORACLE, QUERIES
from pyspark.sql import functions as F

COLS = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def plain(data, shards=8):
    """(doc_id, size, crc, shard, slot) with the rows in order."""
    sized = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in data),
                   key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    total, before, slots, out = sum(r[1] for r in sized), 0, {}, []
    for d, size, crc in sized:
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
        out.append((d, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return out


def test_query_matches_sql(spark):
    got = QUERIES["op12_byte_shards"](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cur = con.execute(ORACLE["op12_byte_shards"])
    assert got.columns == COLS == [d[0] for d in cur.description]
    same(got.collect(), cur.fetchall())
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()


def test_awkward_rows_match_brute_force(spark):
    data = rows()
    got = sharding.shard_documents(with_extra(docs(spark, data)))
    same([(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got.collect()], plain([(r[0], r[1]) for r in data]))


def test_a_hot_key_is_split_and_sizes_are_near_equal(spark):
    data = [(None, "copy " * 20)] * 400 + [(i, "x" * (i % 50)) for i in range(800)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    got = sharding.shard_documents(df).collect()
    same([(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got], plain(data))
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_names_that_clash_and_odd_sizes(spark):
    df = spark.createDataFrame([(1, 5, "a", 9, 9), (2, None, "b", 9, 9), (3, -4, "c", 9, 9), (4, 5, "d", 9, 9)],
                               "id long, size long, _bytes string, shard int, slot int")
    got = sharding.assign(df, 2, ("id",)).orderBy("id")
    assert got.columns == ["id", "size", "_bytes", "shard", "slot"]
    assert [(r.shard, r.slot, r._bytes) for r in got.collect()] == [(0, 0, "a"), (1, 0, "b"), (1, 1, "c"), (1, 2, "d")]
    zero = sharding.assign(df.withColumn("size", F.lit(0)), 2, ("id",)).collect()
    assert sorted((r.shard, r.slot) for r in zero) == [(0, k) for k in range(4)]


def test_empty(spark):
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_written_shards_hold_whole_rows_in_order(spark, tmp_dir):
    path = os.path.join(tmp_dir, "shards")
    df = docs(spark)
    sharding.write_shards(df, path)
    back = spark.read.parquet(path)
    same(back.select(df.columns).collect(), df.collect())
    want = {(d, s): k for d, s, _, k, _ in plain([(r[0], r[1]) for r in rows()])}
    for r in back.collect():
        assert want[r.doc_id, len((r.text or "").encode()) + 1] == r.shard or r.doc_id in (None, 3, 5)
