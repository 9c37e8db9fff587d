"""Receipts of calls and security events in one tamper-evident chain, sealed in segments side by side.

All records stand in one order: time, source, id.  A receipt's hash covers its content and the hash before it.  A chain is
sequential, so it is cut into segments of `SEGMENT` receipts: each starts from a seed that covers the contents of the
whole segment before it and that segment's seed.  Contents are hashed first, in parallel; only the seeds, one for
each segment, are made in a row; then segments are sealed side by side.  A record that is changed, dropped, added or
moved breaks the link after it, or the seed of the next segment.

Verification walks nothing: each receipt is held against the one before it in its segment, each segment's first
against its seed (a join of segments with their predecessors), each content against the live record, and each hash
against its parts.  A receipt's fault is the first of these, as in a walk; the chain's is that of the smallest number.

Defined results: null fields count as empty; records that stand twice get a receipt each; a chain can be extended any
number of times, each time with a new segment; an empty table gives no receipts, and no fault.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.tables import cut, numbered

SEGMENT = 1024
GENESIS = "0" * 64
RECORD = ["ts", "source", "source_id", "action", "provider", "model", "detail", "content_hash"]

#: The frameworks' controls that an event evidences, by type of event; regimes and what they ask for.
AGENTIC, MCP, ACT = "OWASP Agentic", "OWASP MCP", "EU AI Act"
CONTROLS = {
    "path_blocked": [(AGENTIC, "ASI-T05"), (AGENTIC, "LLM06")],
    "command_blocked": [(AGENTIC, "ASI-T04"), (AGENTIC, "LLM05")],
    "mount_blocked": [(AGENTIC, "ASI-T05"), (AGENTIC, "LLM06")],
    "secret_detected": [(AGENTIC, "ASI-T06"), (AGENTIC, "LLM06")],
    "dlp_blocked": [(AGENTIC, "LLM06"), (ACT, "EU AI Act Art. 10")],
    "exfil_blocked": [(AGENTIC, "ASI-T07"), (AGENTIC, "LLM06")],
    "destructive_blocked": [(AGENTIC, "ASI-T04"), (AGENTIC, "LLM05")],
    "obfuscation_blocked": [(AGENTIC, "ASI-T02"), (AGENTIC, "LLM01")],
    "canary_triggered": [(AGENTIC, "ASI-T07"), (AGENTIC, "LLM06")],
    "misdirection_blocked": [(AGENTIC, "ASI-T06"), (AGENTIC, "LLM06")],
    "budget_exceeded": [(AGENTIC, "ASI-T08")],
    "monthly_budget_exceeded": [(AGENTIC, "ASI-T08")],
    "session_budget_exceeded": [(AGENTIC, "ASI-T08")],
    "loop_detected": [(AGENTIC, "ASI-T08")],
    "cost_spiral": [(AGENTIC, "ASI-T08")],
    "mcp_server_not_allowed": [(MCP, "MCP01"), (AGENTIC, "ASI-T03")],
    "mcp_tool_unapproved": [(MCP, "MCP01"), (MCP, "MCP03")],
}
OTHER = [(AGENTIC, "ASI-T01")]
RECORD_KEEPING = [(ACT, "EU AI Act Art. 12"), (ACT, "EU AI Act Art. 26(6)")]
REGIMES = ["SOC 2", "ISO/IEC 42001", "NIST AI RMF", "FINRA 17a-4", "EU AI Act"]


def _lines(kind: str, **fields: Column) -> Column:
    rows = [F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields.items()]
    return F.sha2(F.concat_ws("\n", F.lit(kind), *rows), 256)


def request_records(facts: DataFrame) -> DataFrame:
    """Calls as records; ``facts`` are priced and have block_reason."""
    c = F.col
    content = _lines(
        "request", id=c("id"), ts=F.unix_micros(c("ts").cast("timestamp")), provider=c("provider"), model=c("model"), blocked=c("blocked").cast("int"), reason=c("block_reason"),
        cost=c("nano"), input=c("input_tokens"), cache_write=c("cache_creation_tokens"), cache_read=c("cache_read_tokens"), output=c("output_tokens"), status=c("http_status"),
    )
    action = F.when(c("blocked"), "block").otherwise("forward")
    return facts.select("ts", F.lit("request").alias("source"), c("id").cast("long").alias("source_id"), action.alias("action"), "provider", "model", c("block_reason").alias("detail"), content.alias("content_hash"))


def event_records(events: DataFrame) -> DataFrame:
    """Security events as records: id, ts, event_type, details, provider, model."""
    c = F.col
    content = _lines("security_event", id=c("id"), ts=F.unix_micros(c("ts").cast("timestamp")), type=c("event_type"), details=c("details"), provider=c("provider"), model=c("model"))
    return events.select("ts", F.lit("security_event").alias("source"), c("id").cast("long").alias("source_id"), F.lit("security").alias("action"), "provider", "model", c("event_type").alias("detail"), content.alias("content_hash"))


def digests(receipts: DataFrame) -> DataFrame:
    """(segment, digest): a hash of the contents of each segment, in order."""
    inside = F.array_sort(F.collect_list(F.struct("seq", "content_hash")))  # a segment at most
    return receipts.groupBy("segment").agg(F.sha2(F.array_join(F.transform(inside, lambda x: x["content_hash"]), "\n"), 256).alias("digest"))


def _link(before: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\n", before, content), 256)


def head(chain: DataFrame) -> tuple[int, int, str]:
    """Number and segment that come next, and that segment's seed."""
    last = chain.agg(F.max("segment"), F.max("seq")).first()
    if last[0] is None:
        return 0, 0, GENESIS
    own = chain.filter(F.col("segment") == last[0])
    r = digests(own).crossJoin(own.agg(F.min_by("prev_hash", "seq").alias("seed"))).select(_link(F.col("seed"), F.col("digest"))).first()  # one row by one row
    return last[1] + 1, last[0] + 1, r[0]


def seal(records: DataFrame, chain: DataFrame | None = None, size: int = SEGMENT) -> DataFrame:
    """Receipts of ``records`` that go on from ``chain``: seq, segment, the record, prev_hash, hash."""
    seq, segment, seed = head(chain) if chain is not None else (0, 0, GENESIS)
    d = numbered(records.select(*RECORD), "ts", "source", "source_id", "content_hash", start=seq)
    d = d.withColumn("segment", F.expr(f"(seq - {seq}) div {size} + {segment}"))

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = seed
        for b in batches:
            out = []
            for digest in b["digest"]:
                out.append(now)
                now = sha256(f"{now}\n{digest}".encode()).hexdigest()
            yield pd.DataFrame({"segment": b["segment"], "seed": out})

    starts = digests(d).repartition(1).sortWithinPartitions("segment").mapInPandas(seeds, "segment long, seed string")  # a row for each segment
    d = d.join(starts, "segment").repartition("segment").sortWithinPartitions("segment", "seq")
    fields = ["seq", "segment", *RECORD]

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, ""
        for b in batches:
            before, own = [], []
            for s, seed, content in zip(b["segment"], b["seed"], b["content_hash"], strict=True):
                if s != at:
                    at, last = s, seed
                before.append(last)
                last = sha256(f"{last}\n{content}".encode()).hexdigest()
                own.append(last)
            yield b[fields].assign(prev_hash=before, hash=own)

    kinds = dict(d.dtypes)
    return d.mapInPandas(links, ", ".join(f"{f} {kinds[f]}" for f in fields) + ", prev_hash string, hash string")


def unsealed(records: DataFrame, chain: DataFrame) -> DataFrame:
    return records.join(chain.select("source", "source_id"), ["source", "source_id"], "left_anti")


def extend(chain: DataFrame, records: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Receipts of the records that have none, to be appended to ``chain``."""
    return seal(unsealed(records, chain), chain, size)


def faults(chain: DataFrame, live: DataFrame) -> DataFrame:
    """(seq, source, source_id, reason) of each receipt that doesn't hold; ``live``: the records as they are now."""
    first = chain.groupBy("segment").agg(F.min("seq").alias("first"), F.min_by("prev_hash", "seq").alias("seed"))
    own = first.join(digests(chain), "segment")
    after = own.select((F.col("segment") + 1).alias("segment"), _link(F.col("seed"), F.col("digest")).alias("expected"))
    borders = first.join(after, "segment", "left").select("segment", "first", F.when(F.col("segment") == 0, GENESIS).otherwise(F.col("expected")).alias("expected"))
    before = F.lag("hash").over(Window.partitionBy("segment").orderBy("seq"))
    now = live.groupBy("source", "source_id").agg(F.collect_set("content_hash").alias("now"))
    d = chain.withColumn("before", before).join(borders, "segment").join(now, ["source", "source_id"], "left")
    expected = F.when(F.col("seq") == F.col("first"), F.col("expected")).otherwise(F.col("before"))
    reason = (
        F.when(~F.coalesce(F.col("prev_hash") == expected, F.lit(False)), "broken link").when(F.col("now").isNull(), "source missing")
        .when(~F.array_contains("now", F.col("content_hash")), "source changed").when(F.col("hash") != _link(F.col("prev_hash"), F.col("content_hash")), "hash mismatch")
    )
    return d.select("seq", "source", "source_id", reason.alias("reason")).filter("reason is not null")


def verdict(chain: DataFrame, live: DataFrame) -> DataFrame:
    """One row: receipts, faults, and number, source and reason of the first; nulls where the chain is intact."""
    found = faults(chain, live)
    one = found.agg(F.count("*").alias("faults"), F.min_by(F.struct("seq", "source", "source_id", "reason"), "seq").alias("x"))
    return chain.agg(F.count("*").alias("receipts")).crossJoin(one).select("receipts", "faults", "x.seq", "x.source", "x.source_id", "x.reason")  # one row by one row


def coverage(spark: SparkSession) -> DataFrame:
    """(event_type, framework, control) of every known type of event, in order, records kept for all of them too."""
    rows = [(n, t, f, c) for t, own in CONTROLS.items() for n, (f, c) in enumerate([*own, *RECORD_KEEPING])]
    return spark.createDataFrame(rows, "ord int, event_type string, framework string, control string")


def controls_of(event_type: Column) -> Column:
    """The controls that a type of event evidences; an unknown type has a general one."""
    listed = lambda rows: F.array(*(F.struct(F.lit(f).alias("framework"), F.lit(c).alias("control")) for f, c in rows))
    out = listed([*OTHER, *RECORD_KEEPING])
    for t, own in CONTROLS.items():
        out = F.when(event_type == t, listed([*own, *RECORD_KEEPING])).otherwise(out)
    return out


def control_evidence(chain: DataFrame) -> DataFrame:
    """(framework, control, receipts, first, last) of the receipts of blocks and security events that evidence each control."""
    counted = chain.filter("action <> 'forward'").groupBy("detail").agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b"))
    each = counted.select("n", "a", "b", F.explode(controls_of(F.col("detail"))).alias("c"))
    return each.groupBy("c.framework", "c.control").agg(F.sum("n").alias("receipts"), F.min("a").alias("first_seq"), F.max("b").alias("last_seq"))


def regime_evidence(chain: DataFrame) -> DataFrame:
    """(regime, receipts, blocked, forwarded, first, last): every receipt is evidence of records for each regime."""
    blocked = F.count_if(F.col("action") == "block")
    whole = chain.agg(F.count("*").alias("receipts"), blocked.alias("blocked"), (F.count("*") - blocked).alias("forwarded"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return whole.select(F.explode(F.array(*map(F.lit, REGIMES))).alias("regime"), "*")


def sealed(requests: DataFrame, events: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The chain of all calls and security events, as a table."""
    return cut(seal(request_records(requests).unionByName(event_records(events)), size=size), "chain")
