"""Completeness, monitoring, places and questionnaire texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions import exprs
from quaestor.operators import completeness as cp
from quaestor.operators import geo, monitoring, questionnaire
from quaestor.plans.registry import query, table

# The registry of forms that the queries use: (form, label, hint, grain, rule, n, position, active).
FORMS = [
    ("P", "Ménages", "5_", "etablissement", "fixed_per_etablissement", 4, 1, True), ("O", "Décès", "6_", "etablissement", "etab_field_positive", None, 2, True), ("F", "Personnel", "7_", "etablissement", "by_etablissement_type", None, 3, True),
    ("D1", "Fiche district", "F01", "district", "fixed_per_district", 60, 4, True), ("D2", "Revue", "F07", "district", "floor_sum_district_field", None, 5, True), ("X", "Retirée", "X_", "etablissement", "fixed_per_etablissement", 1, 6, False),
]
FORM_SCHEMA = "form string, label string, hint string, grain string, rule string, n int, position int, active boolean"
FLOORS = [("D2",)]

# The kind of a unit decides its target by keywords; market segments stand for kinds.
KINDS = {"AUTOMOBILE": "CSR-DM", "BUILDING": "Centre CSR", "FURNITURE": "EPH", "HOUSEHOLD": "CSU", "MACHINERY": "Autre"}


def forms(spark) -> DataFrame:
    return spark.createDataFrame(FORMS, FORM_SCHEMA)


def units(spark, d) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("c_mktsegment"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("unit"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("district"), F.col("n_regionkey").alias("region"), (F.col("c_custkey") % 20).alias("agent"), kind.alias("kind"), (F.col("c_custkey") % 3).cast("int").alias("cases"))


def districts(spark, d) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("district"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))


def regions(spark, d) -> DataFrame:
    return table(spark, d, "region").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name"))


def active(spark) -> DataFrame:
    return forms(spark).where("active")


def unit_cells(spark, d) -> DataFrame:
    u = units(spark, d)
    return cp.unit_completeness(u, cp.counts(table(spark, d, "orders"), "o_orderstatus", "o_custkey"), cp.unit_targets(u, active(spark)))


def floors(spark) -> DataFrame:
    return spark.createDataFrame(FLOORS, "form string")


def district_cells(spark, d) -> DataFrame:
    one = table(spark, d, "customer").groupBy(F.lit("D1").alias("form"), F.col("c_nationkey").alias("unit")).agg(F.count("*").alias("n"))
    two = table(spark, d, "supplier").groupBy(F.lit("D2").alias("form"), F.col("s_nationkey").alias("unit")).agg(F.count("*").alias("n"))
    dist = districts(spark, d)
    return cp.district_completeness(dist, one.unionByName(two), cp.district_targets(dist, units(spark, d), active(spark)), floors(spark))


def all_districts(spark, d) -> DataFrame:
    return cp.rolled(unit_cells(spark, d), "district").unionByName(district_cells(spark, d))


def nation(spark, d) -> DataFrame:
    cells = unit_cells(spark, d).select("form", "recu").unionByName(district_cells(spark, d).select("form", "recu"))
    known = spark.createDataFrame([("P",), ("O",), ("D1",), ("D2",)], "form string")
    return cp.national(cells, active(spark), cp.national_targets(units(spark, d), districts(spark, d), active(spark)), known)


GRADE = "round(100.0::DOUBLE * recu / nullif(cible, 0), 1) AS taux, CASE WHEN recu = 0 THEN 'zero' WHEN coalesce(cible,0) = 0 THEN 'suivi' WHEN floor_form THEN 'cible' WHEN recu >= 2*cible THEN 'verifier' WHEN recu >= cible THEN 'cible' ELSE 'en_cours' END AS statut"
BASE = """WITH un AS (SELECT c_custkey AS unit, c_name AS name, c_nationkey AS district, n_regionkey AS region, c_custkey % 20 AS agent, c_mktsegment AS kind, CAST(c_custkey % 3 AS INTEGER) AS cases FROM customer JOIN nation ON c_nationkey = n_nationkey),
ut AS (SELECT unit, district, 'P' AS form, 4 AS cible FROM un UNION ALL SELECT unit, district, 'O', CASE WHEN cases > 0 THEN 1 ELSE 0 END FROM un UNION ALL SELECT unit, district, 'F', CASE kind WHEN 'AUTOMOBILE' THEN 2 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 3 ELSE 1 END FROM un),
oc AS (SELECT o_orderstatus AS form, o_custkey AS unit, count(*) AS n FROM orders GROUP BY 1, 2),
uc0 AS (SELECT ut.unit, ut.district, ut.form, coalesce(oc.n, 0) AS recu, ut.cible, false AS floor_form FROM ut LEFT JOIN oc ON oc.unit = ut.unit AND oc.form = ut.form),
uc AS (SELECT unit, district, form, recu, cible, """ + GRADE + """ FROM uc0),
dt AS (SELECT n_nationkey AS district, 'D1' AS form, 60 AS cible FROM nation UNION ALL SELECT n_nationkey, 'D2', CAST((SELECT coalesce(sum(cases),0) FROM un WHERE un.district = n_nationkey) AS INTEGER) FROM nation),
dn AS (SELECT 'D1' AS form, c_nationkey AS district, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'D2', s_nationkey, count(*) FROM supplier GROUP BY 2),
dc AS (SELECT district, form, recu, cible, """ + GRADE + """ FROM (SELECT dt.district, dt.form, coalesce(dn.n,0) AS recu, dt.cible, dt.form = 'D2' AS floor_form FROM dt LEFT JOIN dn ON dn.district = dt.district AND dn.form = dt.form)),
ud AS (SELECT district, form, recu, cible, """ + GRADE + """ FROM (SELECT district, form, CAST(sum(recu) AS BIGINT) AS recu, CAST(sum(cible) AS BIGINT) AS cible, false AS floor_form FROM uc GROUP BY 1, 2)),
ad AS (SELECT district, form, recu, CAST(cible AS BIGINT) AS cible, taux, statut FROM ud UNION ALL SELECT district, form, recu, cible, taux, statut FROM dc),
nt AS (SELECT form, CAST(sum(cible) AS BIGINT) AS cible FROM (SELECT form, cible FROM ut UNION ALL SELECT form, cible FROM dt) GROUP BY 1),
na AS (SELECT form, recu, cible, CASE WHEN form != 'F' THEN round(100.0::DOUBLE * recu / nullif(cible, 0), 1) END AS taux, CASE WHEN form = 'F' THEN 'inconnu' WHEN recu = 0 THEN 'zero' WHEN coalesce(cible,0)=0 THEN 'suivi' WHEN form = 'D2' THEN 'cible' WHEN recu >= 2*cible THEN 'verifier' WHEN recu >= cible THEN 'cible' ELSE 'en_cours' END AS statut
 FROM (SELECT nt.form, nt.cible, (SELECT CAST(coalesce(sum(recu),0) AS BIGINT) FROM (SELECT form, recu FROM uc UNION ALL SELECT form, recu FROM dc) x WHERE x.form = nt.form) AS recu FROM nt))
"""


def _rolled(source: str, *keys: str, floor: str = "false") -> str:
    k = ", ".join(keys)
    return f"SELECT {k}, form, recu, cible, {GRADE} FROM (SELECT {k}, form, CAST(sum(recu) AS BIGINT) AS recu, CAST(sum(cible) AS BIGINT) AS cible, {floor} AS floor_form FROM {source} GROUP BY {', '.join(map(str, range(1, len(keys) + 2)))}, floor_form)"


@query(BASE + "SELECT * FROM uc")
def unit_completeness(spark, d) -> DataFrame:
    return unit_cells(spark, d)


@query(BASE + "SELECT unit, form, cible FROM ut")
def targets_unit(spark, d) -> DataFrame:
    return cp.unit_targets(units(spark, d), active(spark))


@query(BASE + "SELECT * FROM dt")
def targets_district(spark, d) -> DataFrame:
    return cp.district_targets(districts(spark, d), units(spark, d), active(spark))


@query(BASE + "SELECT * FROM nt")
def targets_national(spark, d) -> DataFrame:
    return cp.national_targets(units(spark, d), districts(spark, d), active(spark))


@query(BASE + "SELECT * FROM dc")
def district_completeness(spark, d) -> DataFrame:
    return district_cells(spark, d)


@query(BASE + "SELECT * FROM ad")
def district_table(spark, d) -> DataFrame:
    return all_districts(spark, d)


@query(BASE + _rolled("(SELECT ad.*, n_regionkey AS region FROM ad JOIN nation ON n_nationkey = district)", "region", floor="form = 'D2'"))
def region_table(spark, d) -> DataFrame:
    cells = all_districts(spark, d).join(districts(spark, d).select("district", "region"), "district")
    return cp.rolled(cells, "region", floors=floors(spark))


@query(BASE + "SELECT n_regionkey AS region, ad.district, form, CAST(sum(recu) AS BIGINT) AS recu FROM ad JOIN nation ON n_nationkey = ad.district GROUP BY form, ROLLUP (n_regionkey, ad.district)")
def geo_rollup(spark, d) -> DataFrame:
    cells = all_districts(spark, d).join(districts(spark, d).select("district", "region"), "district")
    out = cells.rollup("form", "region", "district").agg(F.sum("recu").alias("recu"), F.grouping_id().alias("g"))
    return out.where("g < 7").select("region", "district", "form", "recu")


@query(BASE + "SELECT * FROM na")
def national_summary(spark, d) -> DataFrame:
    return nation(spark, d)


@query(BASE + _rolled("(SELECT uc.*, un.agent FROM uc JOIN un ON un.unit = uc.unit WHERE un.agent < 15)", "agent"))
def agent_table(spark, d) -> DataFrame:
    return cp.agent_table(unit_cells(spark, d), units(spark, d), spark.range(15).select(F.col("id").alias("agent")))


def _supervisors(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("supervisor"), F.col("s_nationkey").alias("district"))


SUP = "(SELECT s_suppkey AS supervisor, form, recu, cible, taux, statut FROM supplier JOIN dc ON district = s_nationkey)"


@query(BASE + f"SELECT * FROM {SUP}")
def supervisor_table(spark, d) -> DataFrame:
    return cp.supervisor_table(district_cells(spark, d), _supervisors(spark, d))


@query(BASE + "SELECT * FROM uc WHERE recu = 0 AND cible > 0")
def anomalies_zero(spark, d) -> DataFrame:
    return cp.zero(unit_cells(spark, d))


@query(BASE + "SELECT *, round(recu::DOUBLE/cible, 2) AS ratio FROM ad WHERE cible > 0 AND recu >= 2*cible AND form != 'D2'")
def anomalies_excess(spark, d) -> DataFrame:
    return cp.excess(all_districts(spark, d), 2.0, floors(spark))


@query(BASE + "SELECT * FROM uc WHERE district = 3 AND form = 'P'")
def anomalies_scope(spark, d) -> DataFrame:
    return cp.scoped(unit_cells(spark, d), district=3, form="P", region=None)


@query(BASE + """SELECT form, CAST(coalesce(sum(CASE WHEN taux >= 100 THEN 1 ELSE 0 END),0) AS BIGINT) AS reached, count(taux) AS rated, round(100.0*sum(CASE WHEN taux >= 100 THEN 1 ELSE 0 END)/nullif(count(taux),0),1) AS share,
CASE WHEN 100.0*sum(CASE WHEN taux >= 100 THEN 1 ELSE 0 END)/count(taux) >= 100 THEN 'cible' WHEN round(100.0*sum(CASE WHEN taux >= 100 THEN 1 ELSE 0 END)/count(taux),1) >= 50 THEN 'en-cours' ELSE 'verifier' END AS band FROM ad GROUP BY 1""")
def district_reached(spark, d) -> DataFrame:
    return cp.reached(all_districts(spark, d))


@query(BASE + """SELECT r_name AS region, n_name AS district, u AS unit, form, recu, cible, taux, statut, CAST(greatest(cible-recu,0) AS BIGINT) AS reste FROM (SELECT district, name AS u, form, recu, cible, taux, statut FROM (SELECT uc.*, un.name FROM uc JOIN un ON un.unit = uc.unit) UNION ALL SELECT district, NULL, form, recu, cible, taux, statut FROM dc) x JOIN nation ON n_nationkey = district JOIN region ON r_regionkey = n_regionkey""")
def export_rows(spark, d) -> DataFrame:
    return cp.export(unit_cells(spark, d), district_cells(spark, d), units(spark, d), districts(spark, d), regions(spark, d))


@query("SELECT 'P' AS form, o_custkey AS unit, count(*) AS n FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 7 = 0 GROUP BY 2")
def unmatched_units(spark, d) -> DataFrame:
    counted = cp.counts(table(spark, d, "orders").where("o_orderstatus = 'P'"), "o_orderstatus", "o_custkey")
    return cp.unmatched(units(spark, d).where("unit % 7 != 0"), counted)


def _reference(spark, d) -> DataFrame:
    s = table(spark, d, "supplier")
    raw = s.select(F.col("s_suppkey").alias("line"), F.concat(F.lit(" "), (F.col("s_suppkey") % 80).cast("string")).alias("code"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("nom"), F.when(F.col("s_suppkey") % 5 == 0, "x").otherwise(F.col("s_nationkey").cast("string")).alias("cible"), F.when(F.col("s_nationkey") > 4, (F.col("s_nationkey") % 4).cast("string")).alias("groupe"))
    return cp.loaded_reference(raw)


REF = """WITH raw AS (SELECT s_suppkey AS line, CAST(s_suppkey % 80 AS VARCHAR) AS code, CASE WHEN s_suppkey % 3 != 0 THEN s_name END AS nom, CASE WHEN s_suppkey % 5 = 0 THEN 'x' ELSE CAST(s_nationkey AS VARCHAR) END AS cible, CASE WHEN s_nationkey > 4 THEN CAST(s_nationkey % 4 AS VARCHAR) END AS groupe FROM supplier),
ref AS (SELECT code, coalesce(nom, code) AS nom, coalesce(try_cast(cible AS INTEGER), 0) AS cible, groupe FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY line DESC) AS k FROM raw) WHERE k = 1),
got AS (SELECT CAST(l_suppkey % 90 AS VARCHAR) AS code, count(*) AS n FROM lineitem GROUP BY 1), pu AS (SELECT code, nom, groupe, recu, cible, """ + GRADE + """ FROM (SELECT ref.*, coalesce(got.n, 0) AS recu, false AS floor_form FROM ref LEFT JOIN got ON got.code = ref.code))
"""


@query(REF + "SELECT * FROM ref")
def ref_load(spark, d) -> DataFrame:
    return _reference(spark, d)


def _project(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.concat((F.col("l_suppkey") % 90).cast("string"), F.lit(" ")).alias("etab"))
    return cp.project_units(_reference(spark, d), rows, "etab")


@query(REF + "SELECT * FROM pu")
def project_units(spark, d) -> DataFrame:
    return _project(spark, d)


@query(REF + f"SELECT groupe, recu, cible, {GRADE} FROM (SELECT coalesce(groupe, '(sans groupe)') AS groupe, CAST(sum(recu) AS BIGINT) AS recu, CAST(sum(cible) AS BIGINT) AS cible, false AS floor_form FROM pu GROUP BY 1)")
def project_groups(spark, d) -> DataFrame:
    return cp.project_groups(_project(spark, d))


@query("SELECT o_orderkey, CASE WHEN r = 0 THEN 'zero' WHEN c = 0 THEN 'suivi' WHEN r >= 2*c THEN 'verifier' WHEN r >= c THEN 'cible' ELSE 'en_cours' END AS plain, CASE WHEN r = 0 THEN 'zero' WHEN c = 0 THEN 'suivi' ELSE 'cible' END AS floored FROM (SELECT o_orderkey, o_orderkey % 11 AS r, o_custkey % 5 AS c FROM orders)")
def status(spark, d) -> DataFrame:
    r, c = F.col("o_orderkey") % 11, F.col("o_custkey") % 5
    return table(spark, d, "orders").select("o_orderkey", exprs.status(r, c).alias("plain"), exprs.status(r, c, True).alias("floored"))


def _assets(spark, d) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("uid"), F.concat((F.col("s_suppkey") % 9).cast("string"), F.lit("_Fiche_f0"), (F.col("s_suppkey") % 9).cast("string")).alias("name"), (F.col("s_nationkey") % 4).cast("long").alias("submission_count"), (F.col("s_suppkey") % 2 == 0).alias("deployed"))


def _mapping(spark, d) -> DataFrame:
    return spark.createDataFrame([("P", "u5"), ("O", "u6"), ("F", "u6"), ("D1", "u1"), ("D2", "u3")], "form string, uid string")


ASSETS = "WITH a AS (SELECT 'u' || s_suppkey AS uid, (s_suppkey % 9) || '_Fiche_f0' || (s_suppkey % 9) AS name, CAST(s_nationkey % 4 AS BIGINT) AS submission_count, s_suppkey % 2 = 0 AS deployed FROM supplier), f(form, hint, position) AS (VALUES ('P','5_',1),('O','6_',2),('F','7_',3),('D1','F01',4),('D2','F07',5)), g AS (SELECT uid, (SELECT arg_min(form, position) FROM f WHERE contains(lower(a.name), lower(hint))) AS form FROM a), m(form, uid) AS (VALUES ('P','u5'),('O','u6'),('F','u6'),('D1','u1'),('D2','u3')) "


@query(ASSETS + "SELECT * FROM g")
def guess_form(spark, d) -> DataFrame:
    return cp.guessed(_assets(spark, d), active(spark))


@query(ASSETS + "SELECT * FROM a")
def assets_sorted(spark, d) -> DataFrame:
    return monitoring.assets_sorted(_assets(spark, d))


@query(ASSETS + "SELECT uid, string_agg(form, ' et ' ORDER BY form) AS forms FROM m GROUP BY 1 HAVING count(*) > 1")
def mapping_errors(spark, d) -> DataFrame:
    return cp.mapping_errors(_mapping(spark, d))


@query(ASSETS + "SELECT m.form, m.uid, a.name FROM m JOIN a ON a.uid = m.uid JOIN f ON f.form = m.form WHERE NOT contains(lower(a.name), lower(f.hint))")
def mapping_warnings(spark, d) -> DataFrame:
    return cp.mapping_warnings(_mapping(spark, d), _assets(spark, d), active(spark))


@query(ASSETS + "SELECT m.uid, 'unlike' AS warning FROM m JOIN g ON g.uid = m.uid WHERE g.form IS NOT NULL AND g.form != m.form UNION ALL SELECT uid, 'shared' FROM m WHERE form IN (SELECT form FROM m GROUP BY 1 HAVING count(*) > 1)")
def tracking_warnings(spark, d) -> DataFrame:
    return cp.tracking_warnings(_mapping(spark, d), _assets(spark, d), active(spark))


@query("SELECT * FROM (VALUES ('P','u9'),('O','u6'),('F','u6'),('D1','u1'),('D2','u3'),('N','u2')) t(form, uid)")
def mapping_upsert(spark, d) -> DataFrame:
    return cp.upserted(_mapping(spark, d), spark.createDataFrame([("P", "u9"), ("N", "u2")], "form string, uid string"), "form", "uid")


@query("SELECT * FROM (VALUES ('b','deux'),('c','trois')) t(key, label)")
def label_upsert(spark, d) -> DataFrame:
    old = spark.createDataFrame([("a", "un"), ("b", "2")], "key string, label string")
    return cp.edited(old, spark.createDataFrame([("a", " "), ("b", " deux"), ("c", "trois")], "key string, label string"), "key", "label", 500)


@query(BASE + "SELECT n_name AS nom, coalesce(taux, 0) AS taux FROM ad JOIN nation ON n_nationkey = district WHERE form = 'P'")
def district_series(spark, d) -> DataFrame:
    return all_districts(spark, d).where("form = 'P'").join(districts(spark, d).select("district", F.col("name").alias("nom")), "district").select("nom", F.coalesce("taux", F.lit(0.0)).alias("taux")).orderBy("nom")


@query("SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS BIGINT) END, s_suppkey, 0) AS target FROM supplier")
def target_precedence(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", F.coalesce(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey").cast("long")), F.col("s_suppkey"), F.lit(0)).alias("target"))


@query("SELECT * FROM (VALUES ('P','Ménages'),('O','Décès'),('F','Personnel'),('D1','Fiche district'),('D2','Revue')) t(form, label)")
def scope_semi(spark, d) -> DataFrame:
    return forms(spark).join(_mapping(spark, d), "form", "left_semi").orderBy("position").select("form", "label")


@query("SELECT * FROM (VALUES ('P',1),('O',2),('F',3),('D1',4),('D2',5)) t(form, position)")
def forms_active(spark, d) -> DataFrame:
    return cp.active_forms(forms(spark)).select("form", "position")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'CSR-DM' WHEN 'BUILDING' THEN 'CSR-D' WHEN 'FURNITURE' THEN 'EPH' WHEN 'HOUSEHOLD' THEN 'CSU' END AS kind FROM customer")
def unit_type(spark, d) -> DataFrame:
    return units(spark, d).select(F.col("unit").alias("c_custkey"), exprs.unit_type(F.col("kind")).alias("kind"))


@query("SELECT c_custkey, upper('Centre ' || c_mktsegment || ' n° ' || c_custkey) AS name FROM customer")
def norm_name(spark, d) -> DataFrame:
    name = F.concat(F.lit("Centre  "), "c_mktsegment", F.lit(" n°   "), F.col("c_custkey").cast("string"), F.lit(" (EPH (EPHR/EPHD)) "))
    return table(spark, d, "customer").select("c_custkey", exprs.normal_name(name).alias("name"))


@query("SELECT 'regions' AS list, CAST(r_regionkey AS VARCHAR) AS code FROM region UNION ALL SELECT 'districts', CAST(n_nationkey AS VARCHAR) FROM nation")
def org_split(spark, d) -> DataFrame:
    choices = regions(spark, d).select(F.lit("Admin_Region_").alias("list_name"), F.col("region").cast("string").alias("name")).unionByName(districts(spark, d).select(F.lit("Admin_District_").alias("list_name"), F.col("district").cast("string").alias("name")))
    parts = cp.split_choices(choices, {"regions": "Admin_Region_", "districts": "Admin_District_"})
    return parts["regions"].select(F.lit("regions").alias("list"), F.col("name").alias("code")).unionByName(parts["districts"].select(F.lit("districts").alias("list"), F.col("name").alias("code")))


def _enriched(spark, d):
    u = units(spark, d).select("unit", F.concat("name", F.lit(" (CSU)")).alias("name"))
    s = [units(spark, d).where(f"unit % 10 = {k}").select(F.lower("name").alias("name"), (F.col("unit") % 4).cast("int").alias("cases")) for k in (1, 2)]
    return cp.enriched(u, [*s, spark.createDataFrame([("Inconnu", 3)], "name string, cases int")])


@query("SELECT c_custkey AS unit, c_name || ' (CSU)' AS name, CASE WHEN c_custkey % 10 IN (1, 2) THEN CAST(c_custkey % 4 AS INTEGER) ELSE 0 END AS cases FROM customer")
def ref_enrich(spark, d) -> DataFrame:
    return _enriched(spark, d)[0]


@query("SELECT 'Inconnu' AS name, 3 AS cases")
def ref_unmatched(spark, d) -> DataFrame:
    return _enriched(spark, d)[1]


@query("SELECT n_nationkey AS district, CASE WHEN n_nationkey = 3 THEN 'Gbêkê' ELSE n_name END AS name, n_regionkey AS region FROM nation")
def names_overlay(spark, d) -> DataFrame:
    return cp.overlaid(districts(spark, d), spark.createDataFrame([(3, "Gbêkê")], "district int, name string"), "district").select("district", "name", "region")


@query(BASE + "SELECT CAST(sum(recu) AS BIGINT) AS recu, CAST(sum(cible) AS BIGINT) AS cible, count(*) AS forms, round(100.0*sum(recu)/sum(cible),1) AS taux FROM na WHERE statut != 'inconnu'")
def global_rate(spark, d) -> DataFrame:
    return cp.global_rate(nation(spark, d))


@query(BASE + """, x AS (SELECT *, coalesce(taux,0) AS t FROM ad), b AS (SELECT form, district, t, row_number() OVER (PARTITION BY form ORDER BY t DESC, district) AS k, row_number() OVER (PARTITION BY form ORDER BY t, district) AS j, CAST(greatest(cible-recu,0) AS BIGINT) AS gap FROM x)
SELECT a.form, a.district AS best, a.t AS best_taux, w.district AS worst, w.t AS worst_taux, w.gap AS reste FROM b a JOIN b w ON w.form = a.form AND w.j = 1 WHERE a.k = 1""")
def best_worst(spark, d) -> DataFrame:
    return cp.best_worst(all_districts(spark, d))


@query(BASE + f"SELECT supervisor, round(avg(taux),1) AS mean_taux, round(avg(taux),1) < 60 AS low FROM {SUP} GROUP BY 1")
def supervisor_mean(spark, d) -> DataFrame:
    return cp.supervisor_means(cp.supervisor_table(district_cells(spark, d), _supervisors(spark, d)))


@query(BASE + f"SELECT form, CAST(sum(CASE WHEN recu=0 AND cible>0 THEN 1 ELSE 0 END) AS BIGINT) AS zero, CAST(sum(CASE WHEN cible>0 AND recu>=2*cible THEN 1 ELSE 0 END) AS BIGINT) AS excess FROM ({_rolled('(SELECT uc.*, un.agent FROM uc JOIN un ON un.unit = uc.unit)', 'agent')}) GROUP BY 1")
def agent_extremes(spark, d) -> DataFrame:
    return cp.agent_extremes(cp.agent_table(unit_cells(spark, d), units(spark, d), spark.range(20).select(F.col("id").alias("agent"))))


@query(BASE + "SELECT form, recu - cible AS ecart FROM na WHERE statut != 'inconnu'")
def form_gaps(spark, d) -> DataFrame:
    return cp.form_gaps(nation(spark, d))


# Time


def _history(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("form")).agg(F.round(F.least(F.lit(100.0), F.count("*") / 2.0), 1).alias("taux"))


HIST = "WITH h AS (SELECT CAST(ts AS DATE) AS date, event_type AS form, round(least(100.0, count(*)/2.0), 1) AS taux FROM events GROUP BY 1, 2) "


@query(HIST + "SELECT * FROM h WHERE date != DATE '2024-01-02' UNION ALL SELECT DATE '2024-01-02', 'click', 50.0::DOUBLE")
def trend_upsert(spark, d) -> DataFrame:
    today = spark.sql("SELECT DATE '2024-01-02' AS date, 'click' AS form, CAST(50.0 AS DOUBLE) AS taux")
    return monitoring.upserted_day(_history(spark, d), today)


@query(HIST + "SELECT * FROM h WHERE date IN (SELECT DISTINCT date FROM h ORDER BY date DESC LIMIT 5)")
def trend_last_n(spark, d) -> DataFrame:
    return monitoring.last_points(_history(spark, d), 5)


@query(HIST + """, r AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY date DESC) AS k FROM h), e AS (SELECT form, arg_min(taux,date) AS t0, arg_max(taux,date) AS t1, date_diff('day',min(date),max(date)) AS days, count(*) AS k FROM r WHERE k <= 8 GROUP BY 1),
n AS (SELECT form, CAST(40 AS BIGINT) AS recu, CAST(1800 AS BIGINT) AS cible FROM (SELECT DISTINCT event_type AS form FROM events)), p AS (SELECT n.form, recu, cible, days, k, (round(t1/100*cible,0)-round(t0/100*cible,0))/nullif(days,0) AS pace FROM n LEFT JOIN e ON e.form=n.form),
s AS (SELECT *, CASE WHEN coalesce(k,0)<2 OR coalesce(days,0)<=0 THEN 'indisponible' WHEN recu>=cible THEN 'cible_atteinte' WHEN pace>0 THEN 'estimee' ELSE 'stagnant' END AS state FROM p)
SELECT form, state, CASE WHEN state!='indisponible' THEN round(pace,1) END AS per_day, CASE WHEN state!='indisponible' THEN CAST(days AS INTEGER) END AS days, CASE WHEN state='estimee' THEN CAST(greatest(1,round((cible-recu)/pace,0)) AS BIGINT) END AS days_left FROM s""")
def velocity(spark, d) -> DataFrame:
    nat = table(spark, d, "events").select(F.col("event_type").alias("form")).distinct().select("form", F.lit(40).cast("long").alias("recu"), F.lit(1800).cast("long").alias("cible"), F.lit("en_cours").alias("statut"))
    return monitoring.velocity(_history(spark, d), nat)


@query("WITH g AS (SELECT n_name AS place, count(*) AS received FROM customer JOIN nation ON n_nationkey=c_nationkey GROUP BY 1), t AS (SELECT CAST(greatest(1, 2000 // count(*)) AS BIGINT) AS target FROM g) SELECT place, received, target, round(100.0*received/target,1) AS rate, CASE WHEN round(100.0*received/target,1)>=100 THEN 'Atteint' WHEN round(100.0*received/target,1)>=50 THEN 'En cours' ELSE 'À risque' END AS state FROM g, t")
def geo_breakdown(spark, d) -> DataFrame:
    df = table(spark, d, "customer").join(districts(spark, d), F.col("c_nationkey") == F.col("district")).select(F.col("name").alias("ENTETE/District__X"))
    return monitoring.place_breakdown(df, monitoring.place_column(df.columns), 2000)


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 10")
def sync_last_n(spark, d) -> DataFrame:
    return monitoring.last_rows(table(spark, d, "events").select("event_id", "event_type"), "event_id", 10)


@query("""WITH l AS (SELECT event_id, user_id AS c FROM events ORDER BY event_id DESC LIMIT 10), a AS (SELECT arg_max(c, event_id) AS received, count(*) AS n FROM l), e AS (SELECT string_agg(CAST(c AS VARCHAR), ',' ORDER BY event_id) AS evolution FROM (SELECT * FROM l ORDER BY event_id DESC LIMIT 7)), m AS (SELECT received, n, round(100.0*received/60,1) AS taux FROM a)
SELECT received, CAST(60 AS BIGINT) AS cible, taux, CASE WHEN taux<90 THEN 1 ELSE 0 END AS active_alerts, evolution, CAST(floor(received/n) AS BIGINT) AS daily_rate, CAST(greatest(1,floor(60/n)) AS BIGINT) AS daily_target, CASE WHEN taux>=95 THEN 'faible' WHEN taux>=80 THEN 'moyen' ELSE 'élevé' END AS risk FROM m, e""")
def dashboard_metrics(spark, d) -> DataFrame:
    return monitoring.dashboard(table(spark, d, "events"), 60, "event_id", "user_id")


@query("""WITH s AS (SELECT s_name AS name, s_suppkey % 3 != 0 AS ok, s_suppkey % 4 = 0 AS pending, s_nationkey AS received, 25 AS target FROM supplier)
SELECT name, CASE WHEN ok THEN 'Synchronisation réussie' ELSE 'Synchronisation échouée' END AS alert, CASE WHEN ok THEN 'Info' ELSE 'Critique' END AS level FROM s UNION ALL SELECT name, 'Nouvelles soumissions prêtes à appliquer', 'Alerte' FROM s WHERE pending UNION ALL SELECT name, 'Rythme faible — ' || (target-received) || ' soumissions manquantes', 'Alerte' FROM s WHERE received < target AND round(100.0*received/target,1) < 80""")
def alerts(spark, d) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 != 0, "réussi").otherwise("erreur").alias("last_status"), (F.col("s_suppkey") % 4 == 0).alias("pending"), F.col("s_nationkey").alias("received"), F.lit(25).alias("target"))
    return monitoring.alerts(s)


@query("SELECT p_partkey, CASE WHEN x >= 95 THEN 'faible' WHEN x >= 80 THEN 'moyen' ELSE 'élevé' END AS risk FROM (SELECT p_partkey, p_size * 2.0 AS x FROM part)")
def risk_band(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", exprs.risk(F.col("p_size") * 2.0).alias("risk"))


@query("SELECT o_orderkey, CASE WHEN c IS NULL THEN 'inconnu' WHEN t = 0 THEN 'suivi' WHEN c <= 0 THEN 'zero' WHEN c >= t THEN 'cible' ELSE 'en_cours' END AS status FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 7 END AS c, o_custkey % 5 AS t FROM orders)")
def tracker_status(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", exprs.tracker_status(F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey") % 7), F.col("o_custkey") % 5).alias("status"))


@query("SELECT event_id, event_type FROM events WHERE lower(event_type) = 'click' ORDER BY event_id DESC LIMIT 500")
def recent_events(spark, d) -> DataFrame:
    log = table(spark, d, "events").select("event_id", "event_type", F.col("event_type").alias("username"))
    return monitoring.recent_events(log, "CLICK", 500, "event_id").drop("username")


@query("SELECT arg_max('completude_' || event_id || '.json', ts) AS path, max(ts) AS mtime FROM events")
def latest_snapshot(spark, d) -> DataFrame:
    return monitoring.latest(table(spark, d, "events").select(F.format_string("completude_%d.json", "event_id").alias("path"), F.col("ts").alias("mtime")))


# Places

POINTS = "(SELECT event_id, event_type, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'nowhere' ELSE (event_id % 200 - 100) || ' ' || ((event_id*7) % 361 - 180) || ' 0 5' END AS g FROM events)"
PARSED = f"(SELECT event_id, event_type, g, CASE WHEN try_cast(split_part(g,' ',1) AS DOUBLE) BETWEEN -90 AND 90 AND try_cast(split_part(g,' ',2) AS DOUBLE) BETWEEN -180 AND 180 THEN try_cast(split_part(g,' ',1) AS DOUBLE) END AS lat, CASE WHEN try_cast(split_part(g,' ',1) AS DOUBLE) BETWEEN -90 AND 90 AND try_cast(split_part(g,' ',2) AS DOUBLE) BETWEEN -180 AND 180 THEN try_cast(split_part(g,' ',2) AS DOUBLE) END AS lon FROM {POINTS})"


def _places(spark, d) -> DataFrame:
    e = F.col("event_id")
    text = F.concat_ws(" ", (e % 200 - 100).cast("string"), ((e * 7) % 361 - 180).cast("string"), F.lit("0 5"))
    return table(spark, d, "events").select("event_id", "event_type", F.when(e % 17 == 0, None).when(e % 19 == 0, "nowhere").otherwise(text).alias("_geolocation"))


@query(f"SELECT event_id, lat, lon FROM {PARSED}")
def parse_gps(spark, d) -> DataFrame:
    return _places(spark, d).withColumn("p", exprs.gps(F.col("_geolocation"))).select("event_id", "p.lat", "p.lon")


@query(f"SELECT lat, lon, event_id FROM {PARSED} WHERE lat IS NOT NULL")
def geo_points(spark, d) -> DataFrame:
    df = _places(spark, d)
    return geo.points(df, geo.place_column(df), ["event_id"])


@query(f"SELECT count(*) AS total, count(lat) AS points, count(*) FILTER (g IS NULL) AS empty, count(*) FILTER (g IS NOT NULL AND lat IS NULL) AS unread FROM {PARSED}")
def geo_diagnostics(spark, d) -> DataFrame:
    return geo.diagnostics(_places(spark, d), "_geolocation")


@query(f"WITH p AS (SELECT lat, lon, greatest(max(lat) OVER () - min(lat) OVER (), max(lon) OVER () - min(lon) OVER ()) AS s FROM {PARSED} WHERE lat IS NOT NULL) SELECT round(avg(lat),5) AS lat, round(avg(lon),5) AS lon, round(max(s),6) AS spread, CASE WHEN max(s)<0.01 THEN 14 WHEN max(s)<0.05 THEN 12 WHEN max(s)<0.2 THEN 10 WHEN max(s)<1 THEN 8 WHEN max(s)<5 THEN 6 ELSE 5 END AS zoom FROM p")
def geo_extent(spark, d) -> DataFrame:
    return geo.extent(geo.points(_places(spark, d), "_geolocation"))


@query(f"SELECT count(*) AS n, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, round(avg(lat),5) AS mean_lat, round(avg(lon),5) AS mean_lon FROM {PARSED} WHERE lat != 0 AND lon != 0")
def geo_stats(spark, d) -> DataFrame:
    return geo.statistics(geo.points(_places(spark, d), "_geolocation"))


@query("""WITH u AS (SELECT user_id, date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) % 9000 AS s FROM events GROUP BY 1)
SELECT user_id, CASE WHEN s > 0 THEN CASE WHEN s < 3600 THEN format('{} min {:02d} s', s//60, s%60) ELSE format('{} h {:02d} min', s//3600, s//60%60) END END AS duration FROM u""")
def duration(spark, d) -> DataFrame:
    u = table(spark, d, "events").groupBy("user_id").agg(((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) % 9000).alias("s"))
    return u.select("user_id", exprs.duration_text(F.col("s")).alias("duration"))


@query("SELECT n_name AS value, CAST((row_number() OVER (ORDER BY n_name) - 1) % 15 AS INTEGER) AS colour FROM nation")
def color_index(spark, d) -> DataFrame:
    return geo.colours(table(spark, d, "nation"), "n_name")


@query("SELECT c_custkey FROM customer WHERE (contains(lower(c_name), '12') OR contains(lower(c_mktsegment), '12')) AND c_mktsegment = 'BUILDING' AND c_nationkey NOT IN (1, 2)")
def map_search(spark, d) -> DataFrame:
    return geo.searched(table(spark, d, "customer"), "12", ["c_name", "c_mktsegment"], {"c_mktsegment": "BUILDING"}, {"c_nationkey": [1, 2]}).select("c_custkey")


@query("SELECT DISTINCT n_name AS value FROM nation WHERE n_regionkey = 2")
def cascade_distinct(spark, d) -> DataFrame:
    return geo.cascade(table(spark, d, "nation"), "n_regionkey", 2, "n_name")


# Texts


@query("SELECT doc_id, CASE WHEN s = '' THEN 'field' ELSE s END AS name FROM (SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(strip_accents(coalesce(text, '')), '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 63) AS s FROM documents)")
def sanitize_name(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", exprs.sanitized(F.col("text")).alias("name"))


@query("SELECT doc_id, 'Age_' || lang || '_1Y' AS name, 'q_1' || source || '_X' AS digit FROM documents")
def xls_name(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", exprs.form_name(F.concat(F.lit("Age_"), "lang", F.lit("__1Y"))).alias("name"), exprs.form_name(F.concat(F.lit("1"), "source", F.lit("__X"))).alias("digit"))


@query("SELECT c_custkey, CASE CAST(c_custkey % 4 AS INTEGER) WHEN 0 THEN '${Enceinte_B} = ''oui''' WHEN 1 THEN '${Sexe_X} = ''femme'' and ${Age_1Y} > 0' WHEN 2 THEN '${Fume_B} = ''non''' ELSE '${Zone_X} != ''tres_urbain''' END AS relevant FROM customer")
def skip_rule(spark, d) -> DataFrame:
    rules = F.element_at(F.array(*map(F.lit, ("Enceinte__B -> @Age", "Sexe__X = Femme ; Age__1Y != 0", "!Fume__B", "Zone__X != Très urbain"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", questionnaire.skip_rule(rules).alias("relevant"))


@query("SELECT p_partkey, 'Distance_' || upper(substr(p_type,1,1)) || lower(substr(p_type,2)) AS radical FROM part")
def radical_from_label(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", questionnaire.radical_from_label(F.concat(F.lit("Quelle est la distance (en km) de l'"), "p_type", F.lit(" ?"))).alias("radical"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS code, s_name AS label FROM supplier UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def learn_anti(spark, d) -> DataFrame:
    old = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("code"), F.col("s_name").alias("label"))
    return questionnaire.learned(old, table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("label")))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", questionnaire.first_json(F.concat(F.lit("reply: ```json "), "props", F.lit(" ```")), "$.k").alias("k"))


@query("""WITH c AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT count(*) AS k, arg_min(v,(-n,v)) AS mode, round(100.0*max(n)/sum(n),1) AS pct, round(sum((n/t)*(n/t)),3) AS h FROM c, (SELECT sum(n) AS t FROM c) GROUP BY ALL)
SELECT format('Mode : « {} » ({:.1f}% des observations valides) · {} modalités — {}.', mode, pct, k, CASE WHEN h >= 0.5 THEN 'distribution très concentrée' WHEN h >= 0.25 THEN 'concentration modérée' ELSE 'distribution équilibrée' END) AS comment FROM s""")
def comment_cat(spark, d) -> DataFrame:
    from quaestor.functions import comments
    from quaestor.operators import frequency

    return frequency.concentration(table(spark, d, "orders"), "o_orderpriority").select(comments.categorical("mode", "mode_pct", "k", "herfindahl").alias("comment"))


@query("""WITH g AS (SELECT o_orderstatus AS r, o_orderpriority AS c, CAST(count(*) AS DOUBLE) AS o FROM orders GROUP BY 1, 2), e AS (SELECT *, sum(o) OVER (PARTITION BY r) * sum(o) OVER (PARTITION BY c) / sum(o) OVER () AS e FROM g),
v AS (SELECT sqrt(sum((o-e)*(o-e)/e)/(sum(o)*2)) AS v, sum((o-e)*(o-e)/e)/2 AS h FROM e), p AS (SELECT v, exp(-h)*(1+h+h*h/2+h*h*h/6) AS p FROM v)
SELECT format('Association {} (V de Cramér = {:.3f}) · {}.', CASE WHEN v < 0.1 THEN 'négligeable' WHEN v < 0.3 THEN 'faible' WHEN v < 0.5 THEN 'modérée' ELSE 'forte' END, round(v, 3), CASE WHEN p < 0.001 THEN 'p < 0.001' WHEN p < 0.01 THEN 'p < 0.01' WHEN p < 0.05 THEN 'p < 0.05' ELSE 'non significatif' END) AS comment FROM p""")
def comment_crosstab(spark, d) -> DataFrame:
    from quaestor.functions import comments
    from quaestor.operators import pivot

    return pivot.chi2(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").select(comments.crosstab("strength", "cramers_v", "significance").alias("comment"))


@query("""WITH s AS (SELECT round(avg(l_quantity),4) AS m, round(stddev_samp(l_quantity),4) AS sd, round(median(l_quantity),4) AS md, round(100*stddev_samp(l_quantity)/avg(l_quantity),4) AS cv FROM lineitem)
SELECT format('Moyenne {:.2f} (écart-type {:.2f}) · Médiane {:.2f} · {}{}.', m, sd, md, CASE WHEN coalesce(cv,0)=0 THEN 'dispersion non calculable' WHEN cv<15 THEN 'faible dispersion' WHEN cv<35 THEN 'dispersion modérée' ELSE 'forte dispersion' END, CASE WHEN abs(m-md)/greatest(abs(md),1.0) > 0.15 THEN ' · distribution asymétrique' ELSE '' END) AS comment FROM s""")
def comment_num(spark, d) -> DataFrame:
    from quaestor.functions import comments
    from quaestor.operators import numeric

    return numeric.summaries(table(spark, d, "lineitem"), ["l_quantity"]).select(comments.continuous("mean", "std", "median", "cv").alias("comment"))


@query("""WITH f AS (SELECT 'a' AS label, sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS n, count(*) AS t FROM lineitem UNION ALL SELECT 'b', sum(CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END), count(*) FROM lineitem)
SELECT format('{} modalités proposées · Modalité la plus citée : « {} » ({:.1f}%).', 2, label, round(100.0*n/t,1)) AS comment FROM f ORDER BY n DESC LIMIT 1""")
def comment_binary(spark, d) -> DataFrame:
    from quaestor.functions import comments
    from quaestor.operators import frequency

    flags = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("q/a"), (F.col("l_linestatus") == "O").cast("int").alias("q/b"))
    best = frequency.binary_group(flags, flags.columns).agg(F.max_by("label", "n_yes").alias("label"), F.max_by("pct", "n_yes").alias("pct"), F.count("*").alias("k"))
    return best.select(comments.binary_group("label", "pct", "k").alias("comment"))


@query(ASSETS + "SELECT a.uid, coalesce(m.form, 'X') AS form FROM a LEFT JOIN (SELECT uid, min(form) AS form FROM m GROUP BY 1) m ON m.uid = a.uid WHERE m.form IS NULL AND contains(lower(a.name), 'fiche_f08')")
def forms_deactivated(spark, d) -> DataFrame:
    registry = forms(spark).withColumn("hint", F.when(F.col("form") == "X", "Fiche_f08").otherwise(F.col("hint")))
    # What an active form's hint also fits goes to the form that comes first.
    return cp.deactivated(_assets(spark, d), _mapping(spark, d), registry)


@query("SELECT o_orderstatus AS \"row\", CAST(o_shippriority AS VARCHAR) AS col, count(*) AS n FROM (SELECT o_orderstatus, o_orderkey % 3 AS o_shippriority FROM orders) GROUP BY 1, 2")
def crosstab_text(spark, d) -> DataFrame:
    from quaestor.operators import pivot

    return pivot.crosstab(table(spark, d, "orders").withColumn("third", F.col("o_orderkey") % 3), "o_orderstatus", "third")
