"""Asserted constants of the field: completeness, registry, mapping, velocity, surveys, dictionary, statistics."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaestor.functions import exprs, stats
from quaestor.operators import cleaning, completeness, dictionary, geo, inference, monitoring, multivariate, numeric, pivot, profiling, questionnaire, surveys


def test_unit_completeness_constants(spark):
    units = spark.createDataFrame([(f"u{i}", i % 12) for i in range(120)], "unit string, district int")
    counts = [0] * 3 + [30] + [15] * 116
    rows = spark.createDataFrame([("F5", f"u{i}") for i, n in enumerate(counts) for _ in range(n)] + [("F5", "unknown")] * 7, "form string, unit string")
    cells = completeness.unit_completeness(units, completeness.counts(rows, "form", "unit"), units.select("unit", F.lit("F5").alias("form"), F.lit(15).alias("cible"))).cache()
    by = {r["unit"]: r for r in cells.collect()}
    assert [by[f"u{i}"]["statut"] for i in range(5)] == ["zero"] * 3 + ["verifier", "cible"]
    assert by["u3"]["taux"] == 200.0 and cells.agg(F.sum("recu"), F.sum("cible")).first() == (1770, 1800)
    assert completeness.zero(cells).count() == 3 and completeness.excess(cells).count() == 1


def test_floor_is_reached_by_any_submission(spark):
    row = spark.range(1).select(exprs.status(F.lit(1), F.lit(16), True), exprs.status(F.lit(0), F.lit(0)), exprs.status(F.lit(3), F.lit(0)), exprs.status(F.lit(32), F.lit(16), True)).first()
    assert tuple(row) == ("cible", "zero", "suivi", "cible")


def test_districts_reached(spark):
    cells = spark.createDataFrame([("F", t) for t in (100.0, 145.0, 99.9, None)], "form string, taux double")
    assert tuple(completeness.reached(cells).first()) == ("F", 2, 3, 66.7, "en-cours")
    low = completeness.reached(spark.createDataFrame([("F", 10.0), ("F", 0.0)], "form string, taux double")).first()
    assert low["band"] == "verifier"
    assert completeness.reached(spark.createDataFrame([("F", None)], "form string, taux double")).first()["band"] is None


def test_mapping(spark):
    forms = spark.createDataFrame([("F6", "6_", 1, True), ("F7", "7_", 2, True), ("F8", "8_", 3, True), ("F07", "F07", 4, True)], "form string, hint string, position int, active boolean")
    assets = spark.createDataFrame([("a", "6_Fiche"), ("b", "7_Fiche"), ("c", "8_Fiche"), ("d", "F07 Grille"), ("e", None)], "uid string, name string")
    right = spark.createDataFrame([("F6", "a"), ("F7", "b"), ("F8", "c"), ("F07", "d")], "form string, uid string")
    wrong = spark.createDataFrame([("F6", "b"), ("F7", "a"), ("F8", "d"), ("F07", "d")], "form string, uid string")
    assert completeness.mapping_errors(right).count() == 0 and completeness.mapping_warnings(right, assets, forms).count() == 0
    assert completeness.mapping_errors(wrong).count() == 1 and completeness.mapping_warnings(wrong, assets, forms).count() == 3
    assert {r["uid"]: r["form"] for r in completeness.guessed(assets, forms).collect()} == {"a": "F6", "b": "F7", "c": "F8", "d": "F07", "e": None}


def test_velocity(spark):
    h = spark.sql("SELECT * FROM VALUES (DATE'2026-01-01','F5',50D),(DATE'2026-01-02','F5',55D),(DATE'2026-01-01','F7',88.7D),(DATE'2026-01-02','F7',88.7D) t(date, form, taux)")
    n = spark.createDataFrame([("F5", 1080, 1800, "en_cours"), ("F7", 1597, 1800, "en_cours"), ("F8", 1, 120, "en_cours")], "form string, recu long, cible long, statut string")
    got = {r["form"]: r for r in monitoring.velocity(h, n).collect()}
    assert (got["F5"]["per_day"], got["F5"]["days_left"]) == (90.0, 8) and got["F7"]["state"] == "stagnant" and got["F8"]["state"] == "indisponible"


def test_place_breakdown(spark):
    df = spark.createDataFrame([("Abengourou",)] * 3 + [("Bondoukou",), (None,)], "`ENTETE/District__X` string")
    rows = monitoring.place_breakdown(df, monitoring.place_column(df.columns), 40).collect()
    assert [(r["place"], r["target"], r["rate"]) for r in rows] == [("Abengourou", 20, 15.0), ("Bondoukou", 20, 5.0)] and {r["state"] for r in rows} == {"À risque"}
    assert monitoring.place_breakdown(spark.createDataFrame([(None,)], "d string"), "d", 40).count() == 0


def test_common_indicators(spark):
    rng = np.random.default_rng(0)
    pick = lambda n, p: ["oui" if x < p else "non" for x in rng.random(n)]
    a = spark.createDataFrame([(int(x), e, "abc"[i % 3]) for i, (x, e) in enumerate(zip(rng.integers(18, 49, 200), pick(200, 0.6), strict=True))], "Age__1Y long, Emploi__B string, Niveau_Instruction__X string")
    b = spark.createDataFrame([(int(x), e, "abc"[i % 3]) for i, (x, e) in enumerate(zip(rng.integers(20, 60, 150), pick(150, 0.9), strict=True))], "Age__1Y long, Emploi__B string, Niveau_Instruction__X string")
    c = spark.createDataFrame([(int(x), "z") for x in rng.integers(15, 70, 100)], "Age__1Y long, Zone__X string")
    named = {"A": a, "B": b, "C": c}
    assert [tuple(r)[:2] + (r["n"],) for r in surveys.common_indicators(spark, named).collect()] == [("Age", "1Y", 3), ("Emploi", "B", 2), ("Niveau_Instruction", "X", 2)]
    found = {name: test.first()["p"] for name, _, _, test in surveys.auto_analysis(named)}
    assert found["Age"] < 0.05 and found["Emploi"] < 0.05 and found["Niveau_Instruction"] >= 0.05
    assert surveys.radical("Region__Appartenance__X") == "Region" and surveys.code_type("Region__Appartenance__X") == "A"


def test_clashing_types_become_text(spark):
    out = surveys.merged({"a": spark.createDataFrame([(1,)], "x int"), "b": spark.createDataFrame([("y",)], "x string")})
    assert dict(out.dtypes)["x"] == "string" and {r["x"] for r in out.collect()} == {"1", "y"}


def test_dictionary(spark):
    survey = [{"type": "begin_group", "name": "g", "label": "Groupe"}, {"type": "select_one gender", "name": "sexe", "label": "Sexe"}, {"type": "end_group"}, {"type": "integer", "name": "age"}, {"type": "select_multiple symptoms", "name": "symptoms"}, {"type": "text", "name": "comment"}, {"type": "note", "name": "n"}, {"type": "select_one yn", "name": "Fume__B"}]
    qs = dictionary.from_form(survey, ["gender", "gender", "yn", "yn", "yn"])
    assert [q.name for q in qs] == ["sexe", "age", "symptoms", "comment", "Fume__B"] and qs[0].section == "Groupe" and qs[1].section == "(hors section)"
    assert qs[0].treatment.startswith("Fréquences") and qs[1].treatment.startswith("Moyenne") and qs[3].treatment.startswith("Exclu") and qs[4].note
    df = spark.createDataFrame([("m", i % 10 + 5, "fever cough" if i % 2 else "fever") for i in range(60)], "`g/sexe` string, age long, symptoms string")
    found, missing, extra = dictionary.matched(qs, df.columns)
    assert found["sexe"] == "g/sexe" and "comment" in missing and not extra
    assert {r["value"]: r["k"] for r in dictionary.multiple(df, "symptoms").collect()} == {"fever": 60, "cough": 30}
    assert dictionary.analysis(df, qs)["univariate"].keys() == {"sexe", "age", "symptoms"}


def test_score_uses_answered_items(spark):
    qs = [dictionary.Question("a", type="select_one x", domain="D", in_score=True, favourable=("y",)), dictionary.Question("b", type="select_one x", domain="D", in_score=True, favourable=("y",), direction="negatif")]
    df = spark.createDataFrame([("y", "y"), ("y", None), (None, None)], "a string, b string")
    assert [(r["Score_D"], r["N_items_D"]) for r in dictionary.scores(df, qs, {"a": "a", "b": "b"}).collect()] == [(50.0, 2), (100.0, 1), (None, 0)]


def test_profile_types(spark):
    rows = [(i, i % 2, i % 5, f"id{i}", "x" * 60 + str(i), "ab"[i % 2], None) for i in range(40)]
    df = spark.createDataFrame(rows, "n int, two int, few int, id string, long string, cat string, none string").withColumn("day", F.current_date())
    assert profiling.types(profiling.profile(df)) == {"n": "continue", "two": "binaire", "few": "categorielle", "id": "categorielle", "long": "texte_libre", "cat": "categorielle", "none": "categorielle", "day": "date"}
    assert profiling.binary_groups({"r/a": "binaire", "r/b": "binaire", "s/a": "binaire"}) == {"r": ["r/a", "r/b"]}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "a string, x double")
    assert numeric.histogram(df, "x").count() == 0 and numeric.outliers(df, "x").first()["count"] == 0
    assert pivot.cells(df, ["a"]).count() == 0
    assert profiling.summary(profiling.profile(df)).first()["n_obs"] == 0
    with pytest.raises(ValueError):
        pivot.cells(df, ["a"], agg="mean")


def test_statistics():
    assert stats.chi2_tail(7.5, 3) == pytest.approx(0.057558452, abs=1e-9) and stats.t_quantile(0.975, 29) == pytest.approx(2.045229642, abs=1e-8)
    w, p = stats.shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.78881, abs=1e-4) and p == pytest.approx(0.0067, abs=1e-4)
    x, p, dof, v = stats.chi2_test([[10, 20], [30, 5]])
    assert dof == 1 and x == pytest.approx(16.578482, abs=1e-5)
    assert stats.f_tail(3.0, 2, 20) == pytest.approx(0.072538, abs=1e-6)
    assert math.isnan(stats.chi2_test([[1, 2], [0, 0]])[0])


def test_ranks_and_spearman(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (2.0, 3.0), (5.0, 9.0), (None, 1.0)], "a double, b double")
    assert sorted(r["rank"] for r in inference.ranked(df, "a").collect()) == [1.0, 2.5, 2.5, 4.0]
    assert inference.spearman(df, ["a", "b"]).first()["rho"] == pytest.approx(0.632456, abs=1e-6)


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    eigen, loadings, scores = multivariate.pca(df, ["a", "b", "c"])
    z = (x - x.mean(0)) / x.std(0)
    assert [r["eigenvalue"] for r in eigen.orderBy("axis").collect()] == pytest.approx(sorted(np.linalg.eigvalsh(np.cov(z.T)), reverse=True), abs=1e-3)
    assert scores.count() == 200 and loadings.groupBy("axis").agg(F.sum(F.pow("loading", F.lit(2)))).first()[1] == pytest.approx(1)
    rows, profile = multivariate.clustered(df, ["a", "b"], 3)
    assert profile.agg(F.sum("n")).first()[0] == 200 and -1 <= multivariate.silhouette(rows) <= 1


def test_mca_total_inertia(spark):
    df = spark.createDataFrame([("xyz"[i % 3], "ab"[i % 2]) for i in range(60)], "a string, b string")
    assert multivariate.mca(df, ["a", "b"], drop_first=False)[0].agg(F.sum("inertia")).first()[0] == pytest.approx(5 / 2 - 1, abs=1e-4)


def test_places(spark):
    df = spark.createDataFrame([("5.18 -4.60 29.0 4.4",), ("[5.18, -4.60]",), ("5.18,-4.60",), ("95 0",), ("x",), (None,)], "_geolocation string")
    assert [tuple(r) for r in geo.points(df, "_geolocation").collect()] == [(5.18, -4.6)] * 3
    assert tuple(geo.diagnostics(df, "_geolocation").first()) == (6, 3, 1, 2)
    comma = spark.createDataFrame([("5,18", "-4,6")], "lat string, lon string")
    assert geo.points(comma, geo.latitude_longitude(comma.columns)).count() == 1


def test_form():
    out = questionnaire.form([{"libelle": "Âge", "pf_question": "Age__1Y!0<N<120", "pf_modalites": "", "pf_skip": ""}, {"libelle": "Sexe", "pf_question": "Sexe__X!1*1Sexe_", "pf_modalites": "Sexe_=[Masculin,Feminin]", "pf_skip": "Age__1Y != 0"}])
    age, sexe = out["survey"]
    assert (age["type"], age["constraint"]) == ("integer", ". >= 0 and . < 120") and (sexe["type"], sexe["relevant"]) == ("select_one sexe", "${Age_1Y} > 0")
    assert [c["name"] for c in out["choices"]] == ["oui", "non", "masculin", "feminin"]
    assert questionnaire.repaired_json('```json\n{"items": [{"a": 1}, {"b"') == {"items": [{"a": 1}]}


def test_column_resolution_and_cleaning(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`g/x` int, _uuid int, precision int")
    assert cleaning.resolve(df, "x") == "g/x" and cleaning.resolve(df, "y") is None and cleaning.cleaned(df).columns == ["g/x"]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 10_000))
def test_wilson_holds_the_share(k, n):
    k = min(k, n)
    p, z = k / n, 1.96
    low = ((p + z * z / (2 * n)) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    assert low <= p + 1e-12


def test_exact_quantiles(spark, monkeypatch):
    from quaestor.operators import quantiles

    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=5000), "b": rng.integers(0, 3, 1000).astype(float), "c": np.array([5.0]), "d": np.array([1.0, 2.0]), "e": np.array([3.0, 1.0, 2.0]), "f": rng.integers(0, 50, 37) / 7, "g": np.repeat([1.0, 9.0], [999, 1001])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("h", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    for accuracy in (10_000, 500):
        monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
        monkeypatch.setattr(quantiles, "MARGIN", 10 / accuracy)
        got = {r["g"]: r["q"] for r in quantiles.quantiles(df.where("g is not null"), ["g"], "x", probs).collect()}
        assert got.keys() == groups.keys()
        for k, x in groups.items():
            assert got[k] == pytest.approx(np.quantile(x, probs).tolist()), k


def test_technical_columns_are_those_of_the_tool(spark):
    names = ["_id", "_submission_time", "_index", "_parent_index", "_parent_table_name", "_submission__id", "_submission___version__", "_attachments", "_version_", "meta/instanceID", "age"]
    assert cleaning.cleaned(spark.createDataFrame([tuple("x" for _ in names)], names)).columns == ["_attachments", "_version_", "meta/instanceID", "age"]


def test_names_lose_all_marks(spark):
    import re
    import unicodedata

    texts = ["Région sanitaire", "šğō ŵ", "e\u0301te\u0301", "日本 x", "", None, "___", "ß", "ẫ" * 80, "".join(map(chr, range(0xC0, 0x180)))]

    def plain(t):
        s = re.sub("_+", "_", re.sub("[^a-zA-Z0-9_]", "_", re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", t or ""))))
        return re.sub("^_+|_+$", "", s)[:63] or "field"

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(exprs.sanitized(F.col("t"))).collect()] == [plain(t) for t in texts]


def test_registry_edits(spark):
    forms = spark.createDataFrame([("F5", "Ménages", "5_", "etablissement", "fixed_per_etablissement", 15, 1, True), ("D1", "District", "F01", "district", "fixed_per_district", 1, 2, True)], "form string, label string, hint string, grain string, rule string, n int, position int, active boolean")
    more = completeness.with_form(forms, " F9 ", "Neuf", "9_", "etablissement", "fixed_per_etablissement", 2)
    assert [tuple(r) for r in completeness.active_forms(more).select("form", "position").collect()] == [("F5", 1), ("D1", 2), ("F9", 3)]
    for bad in ({"code": ""}, {"code": "F5"}, {"grain": "x"}, {"rule": "x"}, {"actor": "x"}):
        with pytest.raises(ValueError):
            completeness.with_form(**{"forms": forms, "code": "N", "label": "", "hint": "", "grain": "district", "rule": "fixed_per_district", **bad})
    off = completeness.set_active(more, "F5", False)
    assert [r["form"] for r in completeness.active_forms(completeness.without_form(off, "D1")).collect()] == ["F9"]
    assets = spark.createDataFrame([("a", "5_Fiche"), ("b", "autre"), ("c", "F01"), ("d", None)], "uid string, name string")
    mapping = spark.createDataFrame([("F5", "b")], "form string, uid string")
    assert {tuple(r) for r in completeness.deactivated(assets, mapping, off).collect()} == {("a", "F5"), ("b", "F5")}
    units, districts = spark.createDataFrame([("u1", 1)], "unit string, district int"), spark.createDataFrame([(1,)], "district int")
    with pytest.raises(ValueError):
        completeness.form_completeness("none", forms, units, districts, spark.createDataFrame([], "form string, unit string, n long"), spark.createDataFrame([], "form string"))


def test_context_columns_of_a_map():
    names = ["Région sanitaire", "Nom du district", "Aire de santé", "Superviseur de l'enquête", "Nom de l'enquêteur", "Date de collecte", "Milieu", "start", "end", "autre"]
    assert geo.context_columns(names) == dict(zip(["region", "district", "aire", "superviseur", "enqueteur", "date", "zone", "start", "end"], names, strict=False))
    assert geo.context_columns(["x"]) == {}


def test_systematic_analysis(spark):
    df = spark.createDataFrame([(float(i), float(i * i), "a" if i % 3 else "b", None) for i in range(60)], "x double, y double, c string, none string")
    out = profiling.systematic(df)
    assert out["profile"].count() == 4 and [r["variable"] for r in out["missing"].collect()] == ["none"]
    assert ("Colonne presque vide", "none") in {(r["anomaly"], r["variable"]) for r in out["anomalies"].collect()}
    assert [name for _, name, _ in out["recommendations"]][0] == "Corrélations"


def test_clusters_are_the_best_of_several_starts(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(30, 2)) * 0.1 + c for c in ((0, 0), (5, 5), (0, 9), (9, 0))])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    rows, profile = multivariate.clustered(df, ["a", "b"], 4, starts=5)
    assert sorted(r["n"] for r in profile.collect()) == [30] * 4


def test_readers_of_reference_files():
    assert completeness.check_reference(["code", "nom"]) and not completeness.check_reference(["code", "cible"])
    assert stats.dagostino(5000, 0.0, 0.0)[1] > 0.5 and stats.dagostino(5000, 1.0, 3.0)[1] < 1e-6
    assert profiling.recommendations({"a": "continue"}) == []
