"""The chain over two sources: order, extension and every way to tamper with it."""

import datetime
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from meterlake.operators import receipts
from meterlake.tables import cut, numbered

NOON = datetime.datetime(2024, 1, 1, 12)


def records(spark, ids, source="request"):
    rows = [(NOON + datetime.timedelta(minutes=i // 3), source, i, "forward", "p", None, None, sha256(f"{source}{i}".encode()).hexdigest()) for i in ids]
    return spark.createDataFrame(rows, "ts timestamp_ntz, source string, source_id long, action string, provider string, model string, detail string, content_hash string")


@pytest.fixture(scope="module")
def live(spark):
    return records(spark, range(40)).unionByName(records(spark, range(0, 40, 2), "security_event"))


@pytest.fixture(scope="module")
def chain(spark, live):
    return cut(receipts.seal(live.repartition(7), size=8), "chain")


def test_order_and_links(chain, live):
    got = chain.orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(60)) and [r["segment"] for r in got] == [i // 8 for i in range(60)]
    order = sorted((r["ts"], r["source"], r["source_id"]) for r in live.collect())
    assert [(r["ts"], r["source"], r["source_id"]) for r in got] == order
    seed = receipts.GENESIS
    for s in range(8):
        own, last = got[8 * s : 8 * s + 8], seed
        for r in own:
            assert r["prev_hash"] == last
            last = sha256(f"{last}\n{r['content_hash']}".encode()).hexdigest()
            assert r["hash"] == last
        digest = sha256("\n".join(r["content_hash"] for r in own).encode()).hexdigest()
        seed = sha256(f"{seed}\n{digest}".encode()).hexdigest()
    assert tuple(receipts.verdict(chain, live).first()) == (60, 0, None, None, None, None)


def test_extended_chain(spark, chain, live):
    assert receipts.extend(chain, live, 8).collect() == []
    more = records(spark, range(30, 70))  # ten of them have receipts
    new = cut(receipts.extend(chain, more, 8), "more")
    whole = chain.unionByName(new)
    every = live.unionByName(records(spark, range(40, 70)))
    got = [r["seq"] for r in new.orderBy("seq").collect()]
    assert got == list(range(60, 90)) and new.agg(F.min("segment")).first()[0] == 8
    assert tuple(receipts.verdict(whole, every).first())[:2] == (90, 0)
    third = cut(receipts.extend(whole, records(spark, [500]), 8), "third")
    assert tuple(receipts.verdict(whole.unionByName(third), every.unionByName(records(spark, [500]))).first())[:2] == (91, 0)
    # a receipt of the first run that is taken out shows, wherever it stood
    for gone in (0, 7, 8, 59, 60):
        assert receipts.verdict(whole.filter(F.col("seq") != gone), every).first()["seq"] in (gone + 1, 8 * (gone // 8 + 1))


def first(chain, live):
    r = receipts.verdict(chain, live).first()
    return r["seq"], r["reason"]


def test_tampering(spark, chain, live):
    at = lambda n, c, x: chain.withColumn(c, F.when(F.col("seq") == n, x).otherwise(F.col(c)))
    forged = F.lit("f" * 64)
    assert first(chain.filter("seq <> 20"), live) == (21, "broken link")
    assert first(chain.filter("segment <> 2"), live) == (24, "broken link")
    assert first(chain.filter("segment <> 0"), live) == (8, "broken link")
    assert first(at(20, "prev_hash", forged), live) == (20, "broken link")
    assert first(at(20, "hash", forged), live) == (20, "hash mismatch")
    assert first(at(20, "content_hash", forged), live) == (20, "source changed")
    r = chain.filter("seq = 20").first()
    is_it = (F.col("source") == r["source"]) & (F.col("source_id") == r["source_id"])
    assert first(chain, live.filter(~is_it)) == (20, "source missing")
    assert first(chain, live.withColumn("content_hash", F.when(is_it, forged).otherwise(F.col("content_hash")))) == (20, "source changed")
    # a receipt sealed anew with its own links leaves the seed of the next segment
    swapped = at(16, "content_hash", forged).withColumn("hash", F.when(F.col("seq") == 16, F.sha2(F.concat_ws("\n", "prev_hash", "content_hash"), 256)).otherwise(F.col("hash")))
    told = {(x["seq"], x["reason"]) for x in receipts.faults(swapped, live).collect()}
    assert (17, "broken link") in told and (24, "broken link") in told
    changed = chain.withColumn("seq", F.when(F.col("seq") == 30, 31).when(F.col("seq") == 31, 30).otherwise(F.col("seq")))
    assert first(changed, live)[1] == "broken link"
    empty = live.filter("false")
    assert receipts.seal(empty).collect() == [] and tuple(receipts.verdict(chain.filter("false"), empty).first())[:2] == (0, 0)


def test_contents(spark):
    facts = spark.createDataFrame([(1, NOON, "p", "m", False, None, 5, 1, 2, 3, 4, 200), (2, NOON, None, None, True, "loop_detected", None, 0, 0, 0, 0, None)], "id long, ts timestamp_ntz, provider string, model string, blocked boolean, block_reason string, nano long, input_tokens long, cache_creation_tokens long, cache_read_tokens long, output_tokens long, http_status int")
    a, b = receipts.request_records(facts).orderBy("source_id").collect()
    assert a["content_hash"] == sha256(b"request\nid=1\nts=1704110400000000\nprovider=p\nmodel=m\nblocked=0\nreason=\ncost=5\ninput=1\ncache_write=2\ncache_read=3\noutput=4\nstatus=200").hexdigest()
    assert (a["action"], b["action"], b["detail"]) == ("forward", "block", "loop_detected")


def test_controls(spark):
    kinds = ["path_blocked", "new_kind", None]
    got = {r["k"]: [x["control"] for x in r["c"]] for r in spark.createDataFrame([(k,) for k in kinds], "k string").select("k", receipts.controls_of(F.col("k")).alias("c")).collect()}
    assert got == {"path_blocked": ["ASI-T05", "LLM06", "EU AI Act Art. 12", "EU AI Act Art. 26(6)"], "new_kind": ["ASI-T01", "EU AI Act Art. 12", "EU AI Act Art. 26(6)"], None: ["ASI-T01", "EU AI Act Art. 12", "EU AI Act Art. 26(6)"]}
    matrix = receipts.coverage(spark)
    assert matrix.select("event_type").distinct().count() == 17 and matrix.groupBy("event_type").count().agg(F.min("count")).first()[0] >= 3


def test_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("c").alias("_task_")).repartition(9)
    assert [(r["x"], r["seq"]) for r in numbered(df, F.desc("x"), start=5).orderBy("seq").collect()] == [(999 - i, i + 5) for i in range(1000)]
    assert numbered(df.filter("false"), "x").collect() == []
