"""Rule packs: TOML files that only add denials, as a dimension of rules applied to texts.

A pack is parsed where its file is read, a row for each file; what it holds becomes rows of rules, what is wrong with it
rows of findings.  Packs are pinned by the hash of their bytes: one that isn't bundled applies only while its hash is
the approved one.  Rules are few (2000 a pack at most), so they are compiled into one projection that normalizes
a text once and tests each rule in the JVM; texts are read once, and only hits are exploded.

Defined results: a null text has no hits; a pack that is too large, no TOML, of wrong types, without id or with too many
rules is rejected as a whole; of others, patterns that don't compile are left out; two rules of one pack that are equal
hit once; a pack that stands twice under one id is the one of the smallest path.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Limits of a pack, its keys, and rules that are too broad.
MAX_BYTES, MAX_RULES = 256 * 1024, 2000
KEYS = ["id", "name", "version", "deny_paths", "deny_commands", "secret_patterns"]
FORBIDDEN = ["allow_paths", "enabled", "detect_secrets", "block_network_mounts"]
BROAD_PATHS = ["", "/", "~", "~/", ".", "/.", "/.env", "/.git", "~/."]
BROAD_COMMANDS = [
    "", "rm", "delete", "git", "kubectl", "helm", "npm", "yarn", "go", "cat", "ls", "curl", "wget", "sudo", "docker", "terraform",
    "python", "python3", "node", "pip",
]
BROAD_PATTERNS = ["", ".", ".*", ".+", ".*?", r"\S+", r"\S*", r"\w+", r"\w*", "(?s).*", r"[\s\S]*"]
#: Bundled packs: id, version, paths, commands, patterns.
BUNDLED = [
    ("django", "1.1.0", ["/settings/secrets.py", "/local_settings.py", "/settings/local.py"], ["manage.py flush", "manage.py sqlflush", "manage.py reset_db"], [("Django SECRET_KEY", r"""SECRET_KEY\s*=\s*['"][^'"]{16,}['"]""")]),
    ("react", "1.1.0", ["/.env.local", "/.env.production", "/.env.development.local", "/.env.production.local", "~/.npmrc", "/.npmrc"], [], [("Private key embedded in frontend env", r"(VITE|REACT_APP|NEXT_PUBLIC)_[A-Z0-9_]*(SECRET|PRIVATE|TOKEN)[A-Z0-9_]*\s*=\s*\S{12,}")]),
    ("infrastructure", "1.1.0", ["/terraform.tfstate", "/terraform.tfstate.backup", "/.terraform/terraform.tfstate", "~/.terraformrc", "~/.terraform.d/credentials.tfrc.json", "~/.ansible/vault_pass"], ["terraform destroy", "terraform apply -auto-approve", "terraform state rm", "terragrunt destroy", "kubectl delete namespace", "pulumi destroy"], [("AWS access key id", r"\bAKIA[0-9A-Z]{16}\b"), ("Terraform Cloud token", r"[A-Za-z0-9]{14}\.atlasv1\.[A-Za-z0-9_\-]{20,}")]),
    ("data-science", "1.1.0", ["/.kaggle/kaggle.json", "~/.kaggle/kaggle.json", "~/.huggingface/token", "/.huggingface/token", "~/.cache/huggingface/token", "~/.config/wandb/settings", "~/.netrc"], [], [("Hugging Face token", "hf_[A-Za-z0-9]{34,}"), ("Weights & Biases API key", r"""WANDB_API_KEY\s*[=:]\s*['"]?[0-9a-f]{40}""")]),
    ("node", "1.0.0", ["~/.npmrc", "/.npmrc", "~/.yarnrc.yml", "/.yarnrc.yml", "~/.config/configstore/update-notifier-npm.json"], [], [("npm access token", "npm_[A-Za-z0-9]{36}")]),
    ("python", "1.0.0", ["~/.pypirc", "/.pypirc", "~/.config/pip/pip.conf", "~/.config/pypoetry/auth.toml", "~/.netrc"], [], [("PyPI upload token", r"pypi-[A-Za-z0-9_\-]{16,}")]),
    ("go", "1.0.0", ["~/.netrc", "/.netrc", "~/.config/go/env"], [], [("GitHub personal access token", "gh[pousr]_[A-Za-z0-9]{36,}")]),
    ("kubernetes", "1.0.0", ["~/.kube/config", "/.kube/config", "/kubeconfig"], ["kubectl delete namespace", "kubectl delete --all", "kubectl delete pvc", "helm uninstall", "kubectl delete deployment --all"], []),
]

PARSED = "path string, content_hash string, id string, version string, accepted boolean, findings array<struct<severity:string,code:string,detail:string>>, rules array<struct<kind:string,name:string,rule:string>>"
RULES = "pack string, kind string, name string, rule string"


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except (re.error, OverflowError):
        return False
    return True


def _well_formed(raw: dict) -> bool:
    """Whether the known keys have their types."""
    texts = lambda x: isinstance(x, list) and all(isinstance(i, str) for i in x)
    patterns = raw.get("secret_patterns", [])
    named = isinstance(patterns, list) and all(isinstance(p, dict) and isinstance(p.get("name"), str) and isinstance(p.get("regex"), str) for p in patterns)
    return all(isinstance(raw.get(k, ""), str) for k in KEYS[:3]) and all(texts(raw.get(k, [])) for k in KEYS[3:5]) and named


def read_pack(text: str) -> tuple:
    """(id, version, accepted, findings, rules) of a pack's text."""
    if len(text.encode()) > MAX_BYTES:
        return None, None, False, [("error", "too-large", f"{len(text.encode())} bytes")], []
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        return None, None, False, [("error", "malformed-toml", str(e)[:200])], []
    found = [("error", "forbidden-key" if k in FORBIDDEN else "unknown-key", k) for k in sorted(raw) if k not in KEYS]
    if not _well_formed(raw):
        return None, None, False, [*found, ("error", "malformed-toml", "types")], []
    ident, version = raw.get("id", ""), raw.get("version", "")
    paths, commands, patterns = raw.get("deny_paths", []), raw.get("deny_commands", []), [(p["name"], p["regex"]) for p in raw.get("secret_patterns", [])]
    n = len(paths) + len(commands) + len(patterns)
    if not ident.strip():
        found.append(("error", "missing-id", ""))
    if not raw.get("name", "").strip():
        found.append(("warning", "missing-name", ""))
    if not version.strip():
        found.append(("warning", "missing-version", ""))
    elif not re.fullmatch(r"[0-9]+\.[0-9]+\.[0-9]+", version.strip()):
        found.append(("warning", "version-format", version))
    if not n:
        found.append(("error", "empty-pack", ""))
    if n > MAX_RULES:
        found.append(("error", "too-many-rules", str(n)))
    found += [("error", "overbroad-path", p) for p in paths if p.strip() in BROAD_PATHS]
    found += [("error", "overbroad-command", c) for c in commands if c.strip() in BROAD_COMMANDS]
    for name, pattern in patterns:
        if not name.strip():
            found.append(("error", "unnamed-pattern", pattern))
        if pattern.strip() in BROAD_PATTERNS:
            found.append(("error", "overbroad-regex", name))
        elif not _compiles(pattern):
            found.append(("error", "bad-regex", name))
    accepted = bool(ident.strip()) and n <= MAX_RULES
    rules = [("path", p, p) for p in paths] + [("command", c, c) for c in commands] + [("pattern", name, p) for name, p in patterns if _compiles(p)]
    return ident, version, accepted, found, rules if accepted else []


def parsed(files: DataFrame) -> DataFrame:
    """Packs with their hash, findings and rules; ``files``: path and text of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, sha256((t or "").encode()).hexdigest(), *read_pack(t or "")) for p, t in zip(b["path"], b["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "content_hash", "id", "version", "accepted", "findings", "rules"])

    return files.select("path", "text").mapInPandas(run, PARSED)


def lint(packs: DataFrame) -> DataFrame:
    """(path, severity, code, detail) of every finding of parsed packs; a pack without errors may be published."""
    return packs.select("path", F.inline("findings"))


def trust(packs: DataFrame, pins: DataFrame) -> DataFrame:
    """Accepted packs with their state: bundled ids are taken, else pinned, changed or new; ``pins``: id, content_hash."""
    first = Window.partitionBy("id").orderBy("path")
    own = packs.filter("accepted").withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")
    last = pins.select("id", F.col("content_hash").alias("pin")).dropDuplicates(["id"])
    state = F.when(F.col("id").isin([p[0] for p in BUNDLED]), "taken").when(F.col("pin").isNull(), "new").when(F.col("pin") == F.col("content_hash"), "pinned").otherwise("changed")
    return own.join(last, "id", "left").withColumn("state", state).drop("pin")


def rules_of(packs: DataFrame) -> DataFrame:
    """(pack, kind, name, rule) of trusted packs that are pinned."""
    return packs.filter("state = 'pinned'").select(F.col("id").alias("pack"), F.inline("rules"))


def bundled(spark: SparkSession) -> DataFrame:
    rows = [(i, k, n, r) for i, _, paths, commands, patterns in BUNDLED for k, n, r in [*(("path", p, p) for p in paths), *(("command", c, c) for c in commands), *(("pattern", n, p) for n, p in patterns)]]
    return spark.createDataFrame(rows, RULES)


def _plain_path(x: str) -> str:
    return x.lower().replace("\\", "/")


def matches(texts: DataFrame, rules: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pack, kind, name) of each rule that a text breaks.  ``rules`` come to the driver: limited by packs, not by texts."""
    given = [tuple(r) for r in rules.distinct().orderBy("pack", "kind", "name", "rule").collect()]

    def hit(kind: str, rule: str) -> Column:
        if kind == "path":
            return F.contains("_p", F.lit("/" + _plain_path(rule[2:]) if rule.startswith("~/") else _plain_path(rule)))
        return F.contains("_c", F.lit(" ".join(rule.lower().split()))) if kind == "command" else F.col("_t").rlike(rule)

    d = texts.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.lower(F.replace(F.col(text), F.lit("\\"), F.lit("/"))).alias("_p"), F.regexp_replace(F.lower(text), r"\s+", " ").alias("_c"))
    each = [F.when(hit(k, r), F.struct(F.lit(p).alias("pack"), F.lit(k).alias("kind"), F.lit(n).alias("name"))) for p, k, n, r in given]
    if not each:
        return d.select(F.col("_k").alias(key), *(F.lit(None).cast("string").alias(c) for c in ("pack", "kind", "name"))).filter(F.lit(False))
    return d.select(F.col("_k").alias(key), F.inline(F.array_distinct(F.array_compact(F.array(*each)))))
