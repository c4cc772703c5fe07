"""URL filter: each URL's host suffixes and path prefixes meet the rules on short hash prefixes, then on full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of the digest that the join is on.
SHORT = 8
#: Rules that may be broadcast, about 200 bytes each; more are joined by a shuffle, each copied to SALTS parts.
BROADCAST_RULES, SALTS = 200_000, 16


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows as a table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def lowered(col: Column) -> Column:
    """A-Z lower-cased; other letters stay."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased; path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    # (?s): a line feed is a character like others.
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*(/[^?#]*)?", 1)
    return lowered(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url; other columns are ignored).

    ``rules`` (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's. The rule
    with the longest host and path together wins; of equal length the longer host, then block, then the smaller text.
    ``rule``: host and path of that rule, null where none fits and ``default`` holds. A null URL and one without ``://`` has
    empty host and path. Repeated rows each have a row; no rows give no rows; without rules ``default`` holds.
    """
    host, path = parts(F.col("url"))
    rules = rules.select("verdict", lowered("host").alias("r_host"), F.col("path").alias("r_path")).where("r_host is not null and r_path is not null and verdict is not null").distinct()
    rules = rules.withColumn("digest", F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256)).withColumn("short", F.substring("digest", 1, SHORT))
    # Host suffixes are those of as many labels as rules have, and path prefixes those of the rules' lengths.
    depths = [r[0] for r in rules.select(F.size(F.split("r_host", r"\.", -1)).alias("n")).distinct().orderBy("n").collect()]
    lengths = [r[0] for r in rules.select(F.char_length("r_path").alias("n")).distinct().orderBy("n").collect()]
    count = rules.count() if lengths else 0
    once = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).groupBy("page_id", "url").agg(F.count("*").alias("copies"))
    once = once.select("page_id", "url", "copies", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.filter(F.array(*[F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in depths]), lambda h: h.isNotNull()) if depths else F.array().cast("array<string>")
    prefixes = F.array(*[F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(F.filter(prefixes, lambda p: p.isNotNull()), lambda p: F.struct(h.alias("h"), p.alias("p")))))
    wide = once.where("host != ''").select("page_id", "url", F.explode(expressions).alias("x")).withColumn("full", F.sha2(F.concat_ws("\n", "x.h", "x.p"), 256)).withColumn("short", F.substring("full", 1, SHORT))
    if count <= BROADCAST_RULES:
        met = wide.join(F.broadcast(rules), "short")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = wide.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["short", "salt"])
    fit = met.where((F.col("full") == F.col("digest")) & (F.col("x.h") == F.col("r_host")) & (F.col("x.p") == F.col("r_path")))
    rank = F.struct((F.char_length("r_host") + F.char_length("r_path")).alias("n"), F.char_length("r_host").alias("m"), (F.col("verdict") == "block").alias("b"))
    best = fit.groupBy(F.col("page_id").alias("b_id"), F.col("url").alias("b_url")).agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "verdict"), rank).alias("best"))
    out = once.join(best.hint("merge"), F.col("page_id").eqNullSafe(F.col("b_id")) & (F.col("url") == F.col("b_url")), "left")
    out = out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), "copies")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")
