"""Trends and the state of collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions.exprs import col, rate, risk

#: Words that name a place column, most wanted first.
PLACES = ("district", "region", "etablissement", "zone")


def upserted_day(history: DataFrame, today: DataFrame) -> DataFrame:
    """History (date, form, taux) with ``today``'s rows in place of their dates' old ones."""
    return history.join(today.select("date").distinct(), "date", "left_anti").unionByName(today)


def last_points(history: DataFrame, n: int) -> DataFrame:
    """The rows of the last ``n`` dates that have any, whatever lies between them."""
    days = history.select("date").distinct().orderBy(F.desc("date")).limit(n)
    return history.join(F.broadcast(days), "date", "left_semi")


def velocity(history: DataFrame, nation: DataFrame, points: int = 8) -> DataFrame:
    """(form, state, per_day, days, days_left): the pace over the last ``points`` rates of each form.

    indisponible: unknown, without target, or under two days; else cible_atteinte, estimee (with days left, 1 at least), stagnant.
    """
    w = Window.partitionBy("form").orderBy(F.desc("date"))
    recent = history.where("taux is not null").withColumn("k", F.row_number().over(w)).where(F.col("k") <= points)
    ends = recent.groupBy("form").agg(F.min_by("taux", "date").alias("t0"), F.max_by("taux", "date").alias("t1"), F.datediff(F.max("date"), F.min("date")).alias("days"), F.count("*").alias("k"))
    out = nation.join(ends, "form", "left")
    gained = F.round(F.col("t1") / 100 * F.col("cible"), 0) - F.round(F.col("t0") / 100 * F.col("cible"), 0)
    pace = gained / F.nullif(F.col("days"), F.lit(0))
    fine = (F.coalesce("cible", F.lit(0)) > 0) & (F.col("statut") != "inconnu") & (F.coalesce("k", F.lit(0)) > 1) & (F.coalesce("days", F.lit(0)) > 0)
    state = F.when(~fine, "indisponible").when(F.col("recu") >= F.col("cible"), "cible_atteinte").when(pace > 0, "estimee").otherwise("stagnant")
    left = F.greatest(F.lit(1), F.round((F.col("cible") - F.col("recu")) / F.nullif(pace, F.lit(0.0)), 0)).cast("long")
    return out.select("form", state.alias("state"), F.when(fine, F.round(pace, 1)).alias("per_day"), F.when(fine, F.col("days")).alias("days"), F.when(state == "estimee", left).alias("days_left"))


def place_column(names: list[str]) -> str | None:
    return next((n for word in PLACES for n in names if word in n.lower()), None)


def place_breakdown(df: DataFrame, name: str, target: int) -> DataFrame:
    """(place, received, target, rate, state), the highest rate first: the target is split evenly over places that occur."""
    got = df.where(col(name).isNotNull()).groupBy(col(name).cast("string").alias("place")).agg(F.count("*").alias("received"))
    each = got.agg(F.greatest(F.lit(1), F.floor(F.lit(target) / F.nullif(F.count("*"), F.lit(0)))).cast("long").alias("target"))
    share = rate(F.col("received"), F.col("target"))
    return got.join(F.broadcast(each)).select("place", "received", "target", share.alias("rate"), F.when(share >= 100, "Atteint").when(share >= 50, "En cours").otherwise("À risque").alias("state")).orderBy(F.desc("rate"), "place")


def last_rows(log: DataFrame, order: str, n: int = 10) -> DataFrame:
    return log.orderBy(F.desc(order)).limit(n)


def dashboard(log: DataFrame, target: int, order: str = "seq", count: str = "count", kept: int = 10, shown: int = 7) -> DataFrame:
    """(received, cible, taux, active_alerts, evolution, daily_rate, daily_target, risk) of the last ``kept`` synchronisations."""
    held = last_rows(log, order, kept).agg(F.sort_array(F.collect_list(F.struct(col(order).alias("o"), col(count).alias("c")))).alias("h"))
    n = F.greatest(F.size("h"), F.lit(1))
    got = F.coalesce(F.get(F.col("h"), F.size("h") - 1)["c"], F.lit(0))
    out = held.select(got.cast("long").alias("received"), F.lit(target).cast("long").alias("cible"), F.transform(F.slice("h", F.greatest(F.size("h") - shown + 1, F.lit(1)), shown), lambda x: x["c"]).alias("evolution"), n.alias("n"))
    out = out.withColumn("taux", F.coalesce(rate(F.col("received"), F.col("cible")), F.lit(0.0)))
    return out.select("received", "cible", "taux", (F.col("taux") < 90).cast("int").alias("active_alerts"), F.array_join(F.col("evolution").cast("array<string>"), ",").alias("evolution"), F.floor(F.col("received") / F.col("n")).cast("long").alias("daily_rate"), F.greatest(F.lit(1), F.floor(F.col("cible") / F.col("n"))).cast("long").alias("daily_target"), risk(F.col("taux")).alias("risk"))


def alerts(state: DataFrame) -> DataFrame:
    """(name, alert, level) of sources (name, last_status, pending, received, target): what each one's state calls for."""
    share = rate(F.col("received"), F.col("target"))
    rules = F.array(
        F.when(F.col("last_status") != "réussi", F.struct(F.lit("Synchronisation échouée").alias("alert"), F.lit("Critique").alias("level"))).otherwise(F.struct(F.lit("Synchronisation réussie").alias("alert"), F.lit("Info").alias("level"))),
        F.when(F.col("pending"), F.struct(F.lit("Nouvelles soumissions prêtes à appliquer").alias("alert"), F.lit("Alerte").alias("level"))),
        F.when((F.col("target") > 0) & (F.col("received") < F.col("target")) & (share < 80), F.struct(F.format_string("Rythme faible — %d soumissions manquantes", F.col("target") - F.col("received")).alias("alert"), F.lit("Alerte").alias("level"))),
    )
    return state.select("name", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("x")).select("name", "x.alert", "x.level")


def recent_events(log: DataFrame, user: str | None = None, n: int = 500, order: str = "seq") -> DataFrame:
    """The last ``n`` events, latest first, of one user whatever the case."""
    log = log.where(F.lower("username") == user.lower()) if user else log
    return log.orderBy(F.desc(order)).limit(n)


def latest(snapshots: DataFrame, path: str = "path", time: str = "mtime") -> DataFrame:
    return snapshots.agg(F.max_by(col(path), col(time)).alias(path), F.max(col(time)).alias(time))


def assets_sorted(assets: DataFrame) -> DataFrame:
    """Deployed forms first, the most submissions first."""
    return assets.orderBy(F.desc("deployed"), F.desc("submission_count"), "uid")
