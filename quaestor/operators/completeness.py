"""Completeness of collection: submissions against targets of an organisational hierarchy.

``counts`` (form, unit, n) is aggregated once and feeds every roll-up. Dimension tables: units (unit, name, district, region,
agent, kind, cases), districts (district, name, region), forms (form, label, hint, grain, rule, n, position, active).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions.exprs import col, normal_name, rate, reached_band, status, unit_type_target

FLOOR_RULE = "floor_sum_district_field"
#: Rows of a dimension table that may be broadcast; larger ones are joined by a shuffle.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """A hint to broadcast, where the table has been counted and is small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def counts(submissions: DataFrame, form: str, unit: str, trimmed: bool = False) -> DataFrame:
    """(form, unit, n). ``trimmed``: units are compared as trimmed text, else as they are."""
    key = F.trim(col(unit).cast("string")) if trimmed else col(unit)
    return submissions.where(key.isNotNull()).groupBy(col(form).alias("form"), key.alias("unit")).agg(F.count("*").alias("n"))


def unit_targets(units: DataFrame, forms: DataFrame) -> DataFrame:
    """(unit, form, cible) for the forms of unit grain."""
    rule = F.col("rule")
    target = (
        F.when(rule == "fixed_per_etablissement", F.col("n")).when(rule == "etab_field_positive", (F.coalesce("cases", F.lit(0)) > 0).cast("int")).when(rule == "by_etablissement_type", unit_type_target(F.col("kind")))
    )
    return units.crossJoin(forms.where("grain = 'etablissement'")).select("unit", "form", target.cast("int").alias("cible"))


def district_targets(districts: DataFrame, units: DataFrame, forms: DataFrame) -> DataFrame:
    """(district, form, cible) for the forms of district grain."""
    cases = units.groupBy("district").agg(F.sum(F.coalesce("cases", F.lit(0))).alias("cases"))
    target = F.when(F.col("rule") == "fixed_per_district", F.col("n")).when(F.col("rule") == FLOOR_RULE, F.coalesce("cases", F.lit(0)))
    return districts.join(cases, "district", "left").crossJoin(forms.where("grain = 'district'")).select("district", "form", target.cast("int").alias("cible"))


def national_targets(units: DataFrame, districts: DataFrame, forms: DataFrame) -> DataFrame:
    """(form, cible)."""
    both = unit_targets(units, forms).select("form", "cible").unionByName(district_targets(districts, units, forms).select("form", "cible"))
    return both.groupBy("form").agg(F.sum("cible").alias("cible"))


def graded(df: DataFrame, floor=False) -> DataFrame:
    """``df`` (recu, cible) with taux and statut."""
    return df.withColumn("taux", rate(F.col("recu"), F.col("cible"))).withColumn("statut", status(F.col("recu"), F.col("cible"), floor))


def unit_completeness(units: DataFrame, counted: DataFrame, targets: DataFrame) -> DataFrame:
    """(unit, district, form, recu, cible, taux, statut) of all units, those without submissions too; other codes vanish."""
    base = units.select("unit", "district").join(targets, "unit")
    got = base.join(counted, ["unit", "form"], "left").withColumn("recu", F.coalesce("n", F.lit(0)).cast("long")).drop("n")
    return graded(got).select("unit", "district", "form", "recu", "cible", "taux", "statut")


def unmatched(units: DataFrame, counted: DataFrame) -> DataFrame:
    """Submissions with codes outside the reference."""
    return counted.join(units.select("unit"), "unit", "left_anti")


def district_completeness(districts: DataFrame, counted: DataFrame, targets: DataFrame, floors: DataFrame) -> DataFrame:
    """(district, form, recu, cible, taux, statut); ``counted``: (form, unit = district code, n); ``floors``: (form) whose target is a floor."""
    got = targets.join(counted.withColumnRenamed("unit", "district"), ["district", "form"], "left").withColumn("recu", F.coalesce("n", F.lit(0)).cast("long"))
    got = got.join(floors.select("form", F.lit(True).alias("floor")), "form", "left").join(districts.select("district"), "district", "left_semi")
    return graded(got, F.coalesce("floor", F.lit(False))).select("district", "form", "recu", "cible", "taux", "statut")


def rolled(cells: DataFrame, *keys: str, floors: DataFrame | None = None) -> DataFrame:
    """Sums of received and target by ``keys`` and form. Forms in ``floors`` are graded as floors."""
    out = cells.groupBy(*keys, "form").agg(F.sum("recu").alias("recu"), F.sum("cible").alias("cible"))
    if floors is None:
        return graded(out)
    out = out.join(floors.select("form", F.lit(True).alias("floor")), "form", "left")
    return graded(out, F.coalesce("floor", F.lit(False))).select(*keys, "form", "recu", "cible", "taux", "statut")


def national(cells: DataFrame, forms: DataFrame, targets: DataFrame, known: DataFrame) -> DataFrame:
    """(form, recu, cible, taux, statut) of all forms; one without a source is ``inconnu`` and keeps its target."""
    sums = cells.groupBy("form").agg(F.sum("recu").alias("got"))
    out = forms.select("form", "rule").join(targets, "form", "left").join(sums, "form", "left").join(known.select("form", F.lit(True).alias("known")), "form", "left")
    recu = F.coalesce("got", F.lit(0)).cast("long")
    out = out.withColumn("recu", recu)
    return out.select("form", "recu", F.col("cible").cast("long").alias("cible"), F.when(F.col("known"), rate(F.col("recu"), F.col("cible"))).alias("taux"), F.when(F.col("known"), status(F.col("recu"), F.col("cible"), F.col("rule") == FLOOR_RULE)).otherwise("inconnu").alias("statut"))


def agent_table(unit_cells: DataFrame, units: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent, form, recu, cible, taux, statut): sums of each agent's units; units of unlisted agents are skipped."""
    return rolled(unit_cells.join(units.select("unit", "agent"), "unit").join(agents.select("agent"), "agent", "left_semi"), "agent")


def supervisor_table(district_cells: DataFrame, supervisors: DataFrame) -> DataFrame:
    """(supervisor, form, ...): the cell of the supervisor's district."""
    return supervisors.select("supervisor", "district").join(district_cells, "district").select("supervisor", "form", "recu", "cible", "taux", "statut")


def zero(cells: DataFrame) -> DataFrame:
    return cells.where("recu = 0 and cible > 0")


def excess(cells: DataFrame, threshold: float = 2.0, floors: DataFrame | None = None) -> DataFrame:
    """Cells with ``threshold`` times their target or more, and that ratio; forms in ``floors`` left out."""
    out = cells.where(F.col("cible") > 0).withColumn("ratio", F.round(F.col("recu") / F.col("cible"), 2)).where(F.col("recu") >= threshold * F.col("cible"))
    return out.join(floors.select("form"), "form", "left_anti") if floors is not None else out


def scoped(cells: DataFrame, **codes: str | None) -> DataFrame:
    """Rows whose columns equal all given codes."""
    for name, code in codes.items():
        if code:
            cells = cells.where(col(name) == code)
    return cells


def reached(cells: DataFrame) -> DataFrame:
    """(form, reached, rated, share, band): districts with a rate of 100 or more among those with one."""
    out = cells.groupBy("form").agg(F.sum((F.col("taux") >= 100).cast("long")).alias("reached"), F.count("taux").alias("rated"))
    share = rate(F.col("reached"), F.col("rated"))
    return out.select("form", F.coalesce("reached", F.lit(0)).alias("reached"), "rated", share.alias("share"), reached_band(share).alias("band"))


def export(unit_cells: DataFrame, district_cells: DataFrame, units: DataFrame, districts: DataFrame, regions: DataFrame) -> DataFrame:
    """The nine columns of the export: names with the code where there is none; cells of units, then of districts."""
    places = districts.select("district", F.col("name").alias("d_name"), "region").join(regions.select("region", F.col("name").alias("r_name")), "region", "left")
    of_units = unit_cells.join(units.select("unit", F.col("name").alias("u_name")), "unit")
    of_districts = district_cells.withColumn("unit", F.lit(None).cast(dict(unit_cells.dtypes)["unit"])).withColumn("u_name", F.lit(None).cast("string"))
    rows = of_units.select("unit", "u_name", "district", "form", "recu", "cible", "taux", "statut").unionByName(of_districts.select("unit", "u_name", "district", "form", "recu", "cible", "taux", "statut"))
    text = lambda c: F.col(c).cast("string")
    return rows.join(small(places), "district", "left").select(F.coalesce("r_name", text("region")).alias("region"), F.coalesce("d_name", text("district")).alias("district"), F.coalesce("u_name", text("unit")).alias("unit"), "form", "recu", "cible", "taux", "statut", F.greatest(F.col("cible") - F.col("recu"), F.lit(0)).cast("long").alias("reste"))


def project_units(reference: DataFrame, submissions: DataFrame, field: str) -> DataFrame:
    """(code, nom, groupe, recu, cible, taux, statut) against a project's own reference; codes are trimmed text."""
    got = submissions.where(col(field).isNotNull()).groupBy(F.trim(col(field).cast("string")).alias("code")).agg(F.count("*").alias("n"))
    out = reference.join(got, "code", "left").withColumn("recu", F.coalesce("n", F.lit(0)).cast("long"))
    return graded(out).select("code", "nom", "groupe", "recu", "cible", "taux", "statut")


def project_groups(units: DataFrame) -> DataFrame:
    """(groupe, recu, cible, taux, statut); no group reads ``(sans groupe)``."""
    group = F.coalesce(F.nullif(F.col("groupe"), F.lit("")), F.lit("(sans groupe)"))
    return graded(units.groupBy(group.alias("groupe")).agg(F.sum("recu").alias("recu"), F.sum("cible").alias("cible"))).orderBy("groupe")


# The reference itself


def loaded_reference(rows: DataFrame) -> DataFrame:
    """(code, nom, cible, groupe) of raw rows (line, code, nom, cible, groupe): trimmed, no empty code, the last line of a code."""
    code = F.trim(F.col("code").cast("string"))
    rows = rows.withColumn("code", code).where("code is not null and code != ''")
    last = rows.groupBy("code").agg(F.max_by(F.struct("nom", "cible", "groupe"), "line").alias("x"))
    return last.select("code", F.coalesce(F.nullif(F.trim("x.nom"), F.lit("")), F.col("code")).alias("nom"), F.coalesce(F.col("x.cible").try_cast("double").cast("int"), F.lit(0)).alias("cible"), F.nullif(F.trim("x.groupe"), F.lit("")).alias("groupe"))


def check_reference(columns: list[str]) -> list[str]:
    """What a reference file lacks; columns are compared without case and blanks."""
    have = {c.strip().lower() for c in columns}
    return [c for c in ("code", "cible") if c not in have]


def split_choices(choices: DataFrame, lists: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a list of choices (list_name, name, label, ...), by what ``lists`` names them."""
    return {table: choices.where(F.col("list_name") == name).drop("list_name") for table, name in lists.items()}


def enriched(units: DataFrame, samples: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Units with ``cases`` from samples (name, cases) by normalised name, and the samples' rows that no unit has."""
    drawn = samples[0]
    for s in samples[1:]:
        drawn = drawn.unionByName(s)
    drawn = drawn.withColumn("key", F.upper(F.regexp_replace(F.trim("name"), r"\s+", " ")))
    keyed = units.withColumn("key", normal_name(F.col("name")))
    by_key = drawn.groupBy("key").agg(F.max("cases").alias("found"))
    return keyed.join(by_key, "key", "left").withColumn("cases", F.coalesce("found", F.lit(0)).cast("int")).drop("key", "found"), drawn.join(keyed.select("key"), "key", "left_anti").drop("key")


def overlaid(table: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """``table`` with the names that ``names`` (key, name) gives."""
    return table.join(names.select(key, F.col("name").alias("__new")), key, "left").withColumn("name", F.coalesce("__new", "name")).drop("__new")


# Forms


def active_forms(forms: DataFrame) -> DataFrame:
    return forms.where("active").orderBy("position")


GRAINS = ("etablissement", "district")
# Who collects a form, and the kinds of target rules.
ACTORS = ("enqueteur", "superviseur")
RULES = ("fixed_per_etablissement", "etab_field_positive", "by_etablissement_type", "fixed_per_district", "floor_sum_district_field")


def with_form(forms: DataFrame, code: str, label: str, hint: str, grain: str, rule: str, n: int | None = None, actor: str = "enqueteur") -> DataFrame:
    """The registry with a new, active form at its end; a code that is empty or taken, or an unknown grain, actor or rule, is an error."""
    if not code or not code.strip():
        raise ValueError("a form needs a code")
    for what, value, known in (("grain", grain, GRAINS), ("actor", actor, ACTORS), ("rule", rule, RULES)):
        if value not in known:
            raise ValueError(f"unknown {what}: {value}")
    if forms.where(F.col("form") == code.strip()).head(1):
        raise ValueError(f"form {code} exists")
    last = forms.agg(F.max("position")).first()[0] or 0
    new = {"form": code.strip(), "label": label, "hint": hint, "grain": grain, "rule": rule, "n": n, "position": last + 1, "active": True, "actor": actor}
    return forms.unionByName(forms.sparkSession.createDataFrame([tuple(new.get(c) for c in forms.columns)], forms.schema))


def set_active(forms: DataFrame, code: str, active: bool) -> DataFrame:
    """The registry with one form switched on or off; an unknown code changes nothing."""
    return forms.withColumn("active", F.when(F.col("form") == code, F.lit(active)).otherwise(F.col("active")))


def without_form(forms: DataFrame, code: str) -> DataFrame:
    return forms.where(F.col("form") != code)


def deactivated(assets: DataFrame, mapping: DataFrame, forms: DataFrame) -> DataFrame:
    """(uid, form): assets that stand for a form that is switched off, by the mapping, else by the first hint in their names."""
    low = assets.select("uid", F.lower("name").alias("low"))
    hints = forms.where("hint != ''").select(F.col("form").alias("hinted"), F.lower("hint").alias("h"), "position")
    by_name = low.join(hints, F.expr("contains(low, h)")).groupBy("uid").agg(F.min_by("hinted", "position").alias("hinted"))
    by_map = mapping.groupBy("uid").agg(F.min("form").alias("mapped"))
    found = assets.select("uid").distinct().join(by_map, "uid", "left").join(by_name, "uid", "left").select("uid", F.coalesce("mapped", "hinted").alias("form"))
    return found.join(forms.where("not active").select("form"), "form", "left_semi").select("uid", "form")


def form_completeness(form: str, forms: DataFrame, units: DataFrame, districts: DataFrame, counted: DataFrame, floors: DataFrame) -> DataFrame:
    """The cells of one form, of units or of districts by its grain; an unknown form is an error."""
    grain = next((r[0] for r in forms.where(F.col("form") == form).select("grain").head(1)), None)
    if grain is None:
        raise ValueError(f"unknown form: {form}")
    own, rows = forms.where(F.col("form") == form), counted.where(F.col("form") == form)
    if grain == "district":
        return district_completeness(districts, rows, district_targets(districts, units, own), floors)
    return unit_completeness(units, rows, unit_targets(units, own))


def guessed(assets: DataFrame, forms: DataFrame) -> DataFrame:
    """(uid, form): the first active form whose hint occurs in the asset's name, whatever the case; null if none."""
    hits = assets.select("uid", F.lower("name").alias("low")).join(forms.where("active").select("form", F.lower("hint").alias("h"), "position"), F.expr("contains(low, h)"))
    return assets.select("uid").join(hits.groupBy("uid").agg(F.min_by("form", "position").alias("form")), "uid", "left")


def mapping_errors(mapping: DataFrame) -> DataFrame:
    """(uid, forms): sources that several forms use."""
    return mapping.groupBy("uid").agg(F.array_join(F.sort_array(F.collect_list("form")), " et ").alias("forms"), F.count("*").alias("n")).where("n > 1").select("uid", "forms")


def mapping_warnings(mapping: DataFrame, assets: DataFrame, forms: DataFrame) -> DataFrame:
    """(form, uid, name): sources whose name lacks the form's hint."""
    out = mapping.join(assets.select("uid", "name"), "uid").join(forms.select("form", "hint"), "form")
    return out.where("hint != '' and name != '' and not contains(lower(name), lower(hint))").select("form", "uid", "name")


def upserted(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """New values over old ones; keys that only one side has stay."""
    return old.select(key, F.col(value).alias("__old")).join(new.select(key, F.col(value).alias("__new")), key, "full").select(key, F.coalesce("__new", "__old").alias(value))


def edited(old: DataFrame, edits: DataFrame, key: str, value: str, longest: int) -> DataFrame:
    """Edits over old texts; an empty edit deletes its key; texts have ``longest`` characters at most."""
    kept = old.join(edits.select(key), key, "left_anti")
    return kept.select(key, value).unionByName(edits.where(F.trim(F.col(value)) != "").select(key, F.substring(F.trim(F.col(value)), 1, longest).alias(value)))


def tracking_warnings(tracked: DataFrame, assets: DataFrame, forms: DataFrame) -> DataFrame:
    """(uid, warning): the form that the name suggests is not the one chosen, or several sources have one form."""
    guess = guessed(assets, forms).withColumnRenamed("form", "guess")
    unlike = tracked.join(guess, "uid").where("guess is not null and guess != form").select("uid", F.lit("unlike").alias("warning"))
    many = tracked.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    return unlike.unionByName(tracked.join(many, "form", "left_semi").select("uid", F.lit("shared").alias("warning")))


# Report figures


def global_rate(nation: DataFrame) -> DataFrame:
    """(recu, cible, taux, forms) over forms that are known."""
    return nation.where("statut != 'inconnu'").agg(F.sum("recu").alias("recu"), F.sum("cible").alias("cible"), F.count("*").alias("forms")).withColumn("taux", rate(F.col("recu"), F.col("cible")))


def best_worst(district_cells: DataFrame) -> DataFrame:
    """(form, best, best_taux, worst, worst_taux, reste): a district without a rate counts as 0; of equals the smaller code."""
    t = F.coalesce("taux", F.lit(0.0))
    cell = F.struct("district", t.alias("t"), F.greatest(F.col("cible") - F.col("recu"), F.lit(0)).cast("long").alias("gap"))
    out = district_cells.groupBy("form").agg(F.min_by(cell, F.struct(-t, F.col("district"))).alias("b"), F.min_by(cell, F.struct(t, F.col("district"))).alias("w"))
    return out.select("form", F.col("b.district").alias("best"), F.col("b.t").alias("best_taux"), F.col("w.district").alias("worst"), F.col("w.t").alias("worst_taux"), F.col("w.gap").alias("reste"))


def supervisor_means(cells: DataFrame, least: float = 60.0) -> DataFrame:
    """(supervisor, mean_taux, low): the mean over forms, and whether it is under ``least``."""
    return cells.groupBy("supervisor").agg(F.round(F.avg("taux"), 1).alias("mean_taux")).withColumn("low", F.col("mean_taux") < least)


def agent_extremes(cells: DataFrame) -> DataFrame:
    """(form, zero, excess): agents without a submission, and with twice the target or more."""
    return cells.groupBy("form").agg(F.sum(((F.col("recu") == 0) & (F.col("cible") > 0)).cast("long")).alias("zero"), F.sum(((F.col("cible") > 0) & (F.col("recu") >= 2 * F.col("cible"))).cast("long")).alias("excess"))


def form_gaps(nation: DataFrame) -> DataFrame:
    """(form, ecart): received less target."""
    return nation.where("statut != 'inconnu'").select("form", (F.col("recu") - F.col("cible")).alias("ecart"))
