"""Destructive commands by shape, and short labels of models."""

from pyspark.sql import functions as F

from meterlake.operators import reports, scan

BAD = [
    "rm -rf /", "rm -fr ~", "rm   -rf   /", "rm --recursive --force ~/", "rm -Rf /*", "sudo rm -rf --no-preserve-root /", "rm -rf $(cat list)", "rm -r -f .", 'bash -c "rm -rf /"',
    '{"command":"rm -rf /"}', "RM -RF ~", "rm -rf ./*", "rm -rf $HOME/", "sh(rm -rf *)", "ls -la; rm -rf /", "echo hi && rm -rf $(cat targets)", "rm -rf ~ | tee log", "cd /tmp && rm -rf *", "rm -rf `cat x`",
    "dd if=/dev/zero of=/dev/sda bs=1M", "mkfs.ext4 /dev/sdb1", "echo x > /dev/sda", "echo x >/dev/nvme0n1", "DROP TABLE users", "drop database production", "DROP  SCHEMA x", "TRUNCATE TABLE orders", "truncate users",
]
GOOD = [
    "rm -rf ./build", "rm -rf node_modules", "rm file.txt", "rm -r logs/old", "rm -rf /etc", "rm -rf /usr/", "PID=$(netstat -ano | grep ':3210' | awk '{print $NF}')\nrm -rf \"C:/Code/viewer/.cache\"",
    'echo "=== a / b ==="\ngrep -rn "rm -rf|disk wipe" src/security/ | head', "ls -la", "cat add.rs && cd charm", "SELECT * FROM users", "git rm --cached file", "DELETE FROM tmp WHERE id = 1", "", "truncate",
]


def test_destructive(spark):
    d = spark.createDataFrame([(t, True) for t in BAD] + [(t, False) for t in GOOD], "t string, bad boolean")
    wrong = d.withColumn("found", scan.destructive(F.col("t"))).filter("found <> bad or found is null").collect()
    assert wrong == [] and spark.createDataFrame([(None,)], "t string").select(scan.destructive(F.col("t"))).first()[0] is None


def test_short_labels(spark):
    names = {
        "claude-sonnet-4-6": "sonnet-4.6", "claude-opus-4-8-20250514": "opus-4.8", "gpt-5.4": "gpt-5.4", "gpt-5.4-mini": "gpt-5.4-mini", "gemini-2.5-pro": "gemini-2.5-pro",
        "claude-opus-4-8[1m]": "opus-4.8[1M]", "claude-opus-4-8-20250514[1m]": "opus-4.8[1M]", " claude-haiku-4-5 ": "haiku-4.5", "x-2024-01": "x-2024.01", "plain": "plain", "a[b": "a[b",
    }
    d = spark.createDataFrame([(k,) for k in names], "m string")
    assert {r["m"]: r["l"] for r in d.select("m", reports.short_label(F.col("m")).alias("l")).collect()} == names
