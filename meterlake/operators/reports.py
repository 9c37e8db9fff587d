"""Spend, latency and attribution reports over usage facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.plans.ratecard import cost, cost_without_cache, hit_rate, nano, priced, prompt_tokens, resolve

TOKENS = ["input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens"]


def usd(x: Column) -> Column:
    """Whole billionths of a dollar as dollars of six digits; never null."""
    return F.floor((F.coalesce(x, F.lit(0)) + 500) / 1000) / 1e6


def since(facts: DataFrame, as_of: str, days: int) -> DataFrame:
    """The trailing days, ``as_of`` included."""
    return facts.filter((F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), max(days, 1) - 1)) & (F.col("day") <= F.lit(as_of).cast("date")))


def total_cost(facts: DataFrame) -> DataFrame:
    return priced(facts).agg(usd(F.sum("nano")).alias("cost_usd"))


def daily_totals(facts: DataFrame) -> DataFrame:
    p = prompt_tokens()
    return priced(facts).groupBy("day").agg(
        usd(F.sum("nano")).alias("cost_usd"), F.count("*").alias("n"), F.count_if("blocked").alias("blocked"),
        F.round(hit_rate(F.sum("cache_read_tokens"), F.sum(p)), 9).alias("hit_rate"),
    )


def breakdown(facts: DataFrame, *by: str) -> DataFrame:
    """Cost, calls and tokens of calls that were not blocked."""
    return priced(facts.filter(~F.col("blocked"))).groupBy(*by).agg(usd(F.sum("nano")).alias("cost_usd"), F.count("*").alias("n"), *[F.sum(t).alias(t) for t in TOKENS]).orderBy(F.desc("cost_usd"), *by)


def session_costs(facts: DataFrame) -> DataFrame:
    return priced(facts.filter("session_id is not null and session_id <> ''")).groupBy("session_id").agg(usd(F.sum("nano")).alias("cost_usd"), F.count("*").alias("n")).orderBy(F.desc("cost_usd"), "session_id")


def last_seen(facts: DataFrame) -> DataFrame:
    return facts.groupBy("provider").agg(F.max("ts").alias("last_seen"))


def counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("day").agg(F.count("*").alias("requests"), F.count_if("blocked").alias("blocked"))


def tag_rollup(facts: DataFrame) -> DataFrame:
    """Cost and calls by tag; values that are no strings, and text that is no JSON object, count nowhere."""
    tagged = priced(facts.filter("tags is not null and tags <> ''"))
    given = F.map_entries(F.from_json("tags", "map<string,variant>"))
    texts = F.filter(given, lambda e: F.schema_of_variant(e["value"]) == "STRING")
    each = tagged.select("nano", F.explode(F.transform(texts, lambda e: F.struct(e["key"].alias("tag"), F.variant_get(e["value"], "$", "string").alias("value")))).alias("e"))
    return each.groupBy("e.tag", "e.value").agg(usd(F.sum("nano")).alias("cost_usd"), F.count("*").alias("n"))


def tag_totals(facts: DataFrame) -> DataFrame:
    """Cost and calls of all tagged rows, malformed ones too."""
    return priced(facts.filter("tags is not null and tags <> ''")).agg(usd(F.sum("nano")).alias("cost_usd"), F.count("*").alias("n"))


def is_error() -> Column:
    return (F.col("http_status") == 0) | (F.col("http_status") >= 400)


def latency_metrics(facts: DataFrame, days: int) -> DataFrame:
    """Nearest-rank percentiles, error rate and calls a day, by model."""
    def at(p: float) -> Column:
        return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency_ms)").cast("long")
    days = max(days, 1)
    m = facts.filter("latency_ms is not null").groupBy("provider", "model").agg(F.count("*").alias("n"), F.count_if(is_error()).alias("errors"), at(0.5).alias("p50"), at(0.95).alias("p95"))
    return m.withColumn("error_rate", F.round(F.col("errors") / F.col("n"), 9)).withColumn("per_day", F.round(F.col("n") / days, 9)).orderBy(F.desc("n"), "provider", "model")


def tool_model(entries: DataFrame) -> DataFrame:
    """Tokens are summed first, the sums are priced."""
    summed = entries.groupBy("tool", "model").agg(F.count("*").alias("n"), *[F.sum(t).alias(t) for t in TOKENS])
    return resolve(summed).select("tool", "model", "n", *TOKENS, usd(nano(cost())).alias("cost_usd"))


def rollup(entries: DataFrame, *by: str) -> DataFrame:
    """Rows are priced first, the costs are summed."""
    return priced(entries).groupBy(*by).agg(usd(F.sum("nano")).alias("cost_usd"), F.count("*").alias("n"))


def under(path: Column, root: Column) -> Column:
    def plain(x: Column) -> Column:
        return F.rtrim(F.lower(F.replace(x, F.lit("\\"), F.lit("/"))), F.lit("/"))
    return (plain(path) == plain(root)) | F.startswith(plain(path), F.concat(plain(root), F.lit("/")))


def by_repository(entries: DataFrame, roots: list[str]) -> DataFrame:
    """Cost by day, repository (the longest root above the workspace), session and model."""
    r = entries.sparkSession.createDataFrame([(x,) for x in roots], "root string")
    places = entries.select("workspace").distinct()
    repo = places.join(F.broadcast(r), under(F.col("workspace"), F.col("root"))).groupBy("workspace").agg(F.max_by("root", F.length("root")).alias("repo"))
    d = priced(entries.join(repo, "workspace", "left"))
    d = d.withColumn("repo", F.coalesce("repo", "workspace", F.lit("(none)"))).withColumn("session", F.coalesce("session_id", F.lit("(unknown)")))
    return d.groupBy("day", "repo", "session", "model").agg(usd(F.sum("nano")).alias("cost_usd"), F.count("*").alias("turns"))


def drift(facts: DataFrame, entries: DataFrame) -> DataFrame:
    """Costs on the wire against those in the logs, by model."""
    w = priced(facts.filter(~F.col("blocked"))).groupBy("model").agg(F.sum("nano").alias("wire"), F.count("*").alias("wire_n"))
    g = priced(entries).groupBy("model").agg(F.sum("nano").alias("logs"), F.count("*").alias("logs_n"))
    both = w.join(g, "model", "full_outer").na.fill(0)
    gap = F.col("logs") - F.col("wire")
    return both.select("model", usd(F.col("wire")).alias("wire"), usd(F.col("logs")).alias("logs"), "wire_n", "logs_n", usd(gap).alias("gap"), F.round(F.when(F.col("wire") != 0, gap / F.col("wire") * 100), 6).alias("gap_pct")).orderBy(F.desc("wire"), "model")


def _by_model(facts: DataFrame) -> DataFrame:
    summed = facts.filter(~F.col("blocked")).groupBy("provider", "model").agg(*[F.sum(t).alias(t) for t in TOKENS])
    return resolve(summed).withColumn("priced", F.col("rate_in").isNotNull()).withColumn("c", nano(cost())).withColumn("w", nano(cost_without_cache()))


def savings(facts: DataFrame) -> DataFrame:
    s = _by_model(facts).agg(F.sum("c").alias("c"), F.sum("w").alias("w"))
    return s.select(usd(F.col("c")).alias("real"), usd(F.col("w")).alias("without_cache"), usd(F.greatest(F.col("w") - F.col("c"), F.lit(0))).alias("captured"))


def opportunities(facts: DataFrame, least_usd: float = 0.5, below_percent: float = 30) -> DataFrame:
    """Models of some spend whose prompts come from the cache for less than ``below_percent`` in 100."""
    m = _by_model(facts).withColumn("share", F.col("cache_read_tokens") / F.when(prompt_tokens() > 0, prompt_tokens()) * 100)
    return m.filter((F.col("c") >= round(least_usd * 1e9)) & (F.col("share") < below_percent)).select("provider", "model", usd(F.col("c")).alias("cost_usd"), F.round("share", 6).alias("share"))


def accuracy(facts: DataFrame) -> DataFrame:
    """What a counter without knowledge of the cache overstates."""
    m = _by_model(facts).withColumn("over", F.greatest(F.col("w") - F.col("c"), F.lit(0)))
    return m.select("provider", "model", usd(F.col("c")).alias("real"), usd(F.col("w")).alias("naive"), usd(F.col("over")).alias("overstated")).orderBy(F.desc("overstated"), "provider", "model")


def digest(facts: DataFrame) -> DataFrame:
    return priced(facts).agg(
        usd(F.sum("nano")).alias("cost_usd"), F.count_if(~F.col("blocked")).alias("turns"), F.count_if("blocked").alias("blocked"),
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
    )


def dense_days(facts: DataFrame, as_of: str, days: int) -> DataFrame:
    """Each of the trailing days, those without calls at 0, with the running total."""
    from pyspark.sql import Window
    spark = facts.sparkSession
    all_days = spark.range(days).select(F.date_sub(F.lit(as_of).cast("date"), F.col("id").cast("int")).alias("day"))
    spent = priced(since(facts, as_of, days)).groupBy("day").agg(F.sum("nano").alias("c"))
    joined = all_days.join(spent, "day", "left").withColumn("c", F.coalesce("c", F.lit(0)))  # `days` rows
    return joined.select("day", usd(F.col("c")).alias("cost_usd"), usd(F.sum("c").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))).alias("running"))


def burndown(facts: DataFrame, as_of: str) -> DataFrame:
    """The month's spend so far and its projection to the month's end."""
    day = F.lit(as_of).cast("date")
    month = facts.filter((F.col("day") >= F.trunc(day, "month")) & (F.col("day") <= day))
    s = priced(month).agg(F.coalesce(F.sum("nano"), F.lit(0)).alias("s"))
    return s.select(usd(F.col("s")).alias("spent"), usd(F.col("s") / F.dayofmonth(day) * F.dayofmonth(F.last_day(day))).alias("projected"))


def latest(facts: DataFrame) -> DataFrame:
    """The newest call that was not blocked."""
    return facts.filter(~F.col("blocked")).orderBy(F.desc("ts"), F.desc("id")).limit(1).select("id", "ts", "provider", "model")


def short_label(model: Column) -> Column:
    """A model's name without a date of eight digits and the first family's prefix, a minor version after a dot; a bracketed
    tag at the end stays, in upper case."""
    x = F.trim(model)
    tag = F.upper(F.regexp_extract(x, r"\[[^\[]*\]$", 0))
    x = F.regexp_replace(F.regexp_replace(x, r"\[[^\[]*\]$", ""), r"-[0-9]{8}$", "")
    return F.concat(F.regexp_replace(F.regexp_replace(x, "^claude-", ""), r"([0-9])-([0-9]+)$", "$1.$2"), tag)
