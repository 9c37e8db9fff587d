"""Operator 9, secret scans: an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its text).  The ledger says which
blobs have been scanned under which rule version; only unseen pairs are scanned, each blob once
however many paths and versions hold it, and findings are joined back to all of them.

Moves: (key, address) rows, one text per distinct unseen blob (copies are combined before the
shuffle), and findings.  Findings and ledger are tables, so a later run over a grown corpus scans
the new blobs alone.

Defined results: null text is the empty text; ties and repeated rows share a blob and get the same
findings, one row each; ledger rows that stand twice count once; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import cut

#: Fixed values of the base rules, in the order in which kinds are listed.  Words of the first in any case.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

#: Rules of the method, kind and pattern; they add spans.
MORE = [
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")),
    ("github", re.compile(r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")),
    ("slack", re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
]
KINDS = ["assign", "access", "hex", *(k for k, _ in MORE)]
#: Goes up with every change of a rule; it is part of the ledger's key.
RULE_VERSION = 1

FINDINGS = "blob binary, rule_version int, n_assign long, n_access long, n_hex long, base string, spans string"


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, base kinds first, each kind in text order."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found + [(kind, m.start(), m.end()) for kind, p in MORE for m in p.finditer(text)]


def listed(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tk.blocks(batches):
        rows = []
        for blob, text in zip(batch.column("blob").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = spans_of(text)
            base = [s for s in found if s[0] in KINDS[:3]]
            counts = [sum(s[0] == k for s in base) for k in KINDS[:3]]
            rows.append((blob, RULE_VERSION, *counts, listed(base), listed(found)))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["blob", "rule_version", "n_assign", "n_access", "n_hex", "base", "spans"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def address(versions: DataFrame, text: str = "text") -> DataFrame:
    """The input with ``blob``, the content address of its text."""
    return versions.withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))


def update(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Findings of the blobs that ``ledger`` (earlier findings) lacks under this rule version.

    Append the result to the ledger.  A blob without findings gets a row too: it has been scanned.
    """
    v = address(versions.select(F.coalesce(F.col(text), F.lit("")).alias("text")))
    if ledger is not None:
        done = ledger.filter(F.col("rule_version") == RULE_VERSION).select("blob").distinct()
        v = v.join(done, "blob", "left_anti")
    return v.groupBy("blob").agg(F.min("text").alias("text")).mapInArrow(_scan, FINDINGS)


def scan(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(findings of every row of ``versions`` by key, the new ledger)."""
    fresh = cut(update(versions, ledger, text), "ledger")
    known = fresh if ledger is None else ledger.unionByName(fresh)
    # a part of the ledger may have been appended twice
    now = known.filter(F.col("rule_version") == RULE_VERSION).drop("rule_version").dropDuplicates(["blob"])
    paths = address(versions.select(F.col(key), F.col(text).alias("text"))).drop("text")
    return paths.join(now, "blob").drop("blob"), known


def scan_into(versions: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Findings of every row of ``versions``, with the ledger kept as Parquet under ``path``: what it has is not
    scanned again, and what is new is appended.  ``path`` is in a folder that all executors share."""
    spark = versions.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    ledger = spark.read.schema(FINDINGS).parquet(path) if there else None
    fresh = cut(update(versions, ledger, text), "ledger")
    fresh.write.mode("append").parquet(path)
    return scan(versions, spark.read.schema(FINDINGS).parquet(path), text, key)[0]


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
