"""Analysis that a variable dictionary drives. The dictionary is metadata (a row for each question) and generates expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions.exprs import Z95, col, number, wilson
from quaestor.operators import inference
from quaestor.operators.quantiles import of_variables
from quaestor.operators.surveys import stat_key

SUFFIX = re.compile(r"__(\d[A-Za-z]{0,2}|[A-Za-z]{1,2})\Z")
#: How many choices a coded question has.
CARDINALITY = {"B": 2, "C": 3}
# Question types that hold no answer.
TECHNICAL = ("image", "audio", "video", "file", "barcode", "acknowledge", "hidden", "start", "end", "today", "deviceid", "username", "phonenumber", "audit", "note", "begin_group", "end_group", "begin_repeat", "end_repeat")
# Recommended treatment of a variable by its statistical key, else by its question type.
TREATMENTS = {
    "B": "Proportion (%) + IC95% (Wilson) — bivarié : χ² ou Fisher exact (effectifs <5) — multivarié : régression logistique",
    "C": "Proportions par modalité + IC95% — bivarié : χ² ou Fisher exact — multivarié : régression logistique (après regroupement binaire si besoin)",
    "X_one": "Fréquences par modalité (%) + IC95% — bivarié : χ² ou Fisher exact — multivarié : régression logistique (modalité de référence) ou multinomiale",
    "X_multi": "Proportion « oui » par item (%) + IC95% — bivarié : test par item (χ²/Fisher) — envisager un score composite (numérateur/dénominateur) — multivarié : régression logistique par item ou sur le score composite",
    "period": "Moyenne ± écart-type OU médiane [IQR] selon normalité (Shapiro-Wilk) — bivarié : t-test/Mann-Whitney (2 groupes), ANOVA/Kruskal-Wallis (>2 groupes) — multivarié : régression linéaire (ou log-linéaire si distribution asymétrique)",
    "A": "Non analysé directement comme continu — dérive un délai/une durée si pertinent, sinon utilisé pour stratification temporelle uniquement",
    "Z": "Exclu de l'analyse quantitative (texte libre, identifiant technique ou verbatim)",
    "E": "Exclu de l'analyse quantitative (identifiant) — sauf usage en stratification qualité",
    "I": "Moyenne ± écart-type ou médiane [IQR] (comme continu) — bivarié : t-test/Mann-Whitney ou ANOVA/Kruskal-Wallis — multivarié : régression linéaire",
    "select_one": "Fréquences par modalité (%) + IC95% (Wilson) — bivarié : χ²/Fisher — multivarié : régression logistique",
    "select_multiple": "Proportion « oui » par item (%) + IC95% — envisager un score composite — multivarié : régression logistique par item",
    **dict.fromkeys(("integer", "decimal", "range"), "Moyenne ± écart-type OU médiane [IQR] selon normalité — t-test/Mann-Whitney/ANOVA/Kruskal-Wallis — régression linéaire"),
    **dict.fromkeys(("date", "dateTime", "time"), "Non analysé directement comme continu — dérive un délai/une durée si pertinent"),
    "text": "Exclu de l'analyse quantitative (texte libre) — analyse qualitative séparée possible",
    "calculate": "À valider manuellement (champ calculé — dépend de la formule)",
    **dict.fromkeys(("geopoint", "geotrace", "geoshape"), "Exclu de l'analyse statistique (cartographie uniquement)"),
}
NO_ANSWER, UNKNOWN_TYPE = "Exclu de l'analyse quantitative (champ technique)", "À déterminer manuellement (type non reconnu)"


@dataclass(frozen=True)
class Question:
    name: str
    section: str = "(hors section)"
    label: str = ""
    type: str = "text"
    choices: str = ""
    suffix: str = ""
    role: str = "indicateur"
    domain: str = ""
    in_score: bool = False
    direction: str = ""
    favourable: tuple[str, ...] = ()
    treatment: str = ""
    relevant: str = ""
    note: str = ""

    @property
    def key(self) -> str | None:
        """The statistical key: by the suffix, else by the question's type."""
        return stat_key(self.suffix, self.type.startswith("select_multiple")) or {"select_one": "X_one", "select_multiple": "X_multi", "integer": "period", "decimal": "period", "range": "period"}.get(self.type.split(" ")[0])


def suffix(name: str) -> str:
    return m[1] if (m := SUFFIX.search(name)) else ""


def treatment(kind: str, code: str, multiple: bool) -> str:
    """By statistical key, then by question type, then technical, then undetermined."""
    simple = kind.split(" ")[0]
    return TREATMENTS.get(stat_key(code, multiple) or "") or TREATMENTS.get(simple) or (NO_ANSWER if simple in TECHNICAL else UNKNOWN_TYPE)


def role(choices: str, kind: str) -> str:
    low = choices.lower()
    if low.startswith("admin_") or "region" in low or "district" in low:
        return "stratification"
    return "exclu" if kind.split(" ")[0] in TECHNICAL else "indicateur"


def from_form(survey: list[dict], choice_lists: list[str] = ()) -> list[Question]:
    """The dictionary of a form's survey rows (type, name, label..., relevant...); ``choice_lists``: the list of each choice."""
    out, sections = [], []
    sizes = {n: choice_lists.count(n) for n in {*choice_lists}}
    find = lambda row, start: next((row[k] for k in row if k.lower().startswith(start) and row[k]), "")
    for row in survey:
        kind, name = str(row.get("type") or "").strip(), row.get("name")
        if kind.startswith("begin_group"):
            sections.append(str(find(row, "label") or name))
        elif kind.startswith("end_group"):
            sections[-1:] = []
        elif name and not kind.startswith(("note", "begin_repeat", "end_repeat")):
            simple, _, choices = kind.partition(" ")
            code, multiple = suffix(str(name)), simple == "select_multiple"
            want = CARDINALITY.get(code)
            note = f"__{code}: {want} modalités attendues, {sizes[choices]} trouvées" if want and simple == "select_one" and sizes.get(choices, want) != want else ""
            out.append(Question(str(name), sections[-1] if sections else "(hors section)", str(find(row, "label")), kind, choices, code, role(choices, kind), treatment=treatment(kind, code, multiple), relevant=str(find(row, "relevant")), note=note))
    return out


def revised(questions: list[Question], edits: dict[str, dict]) -> list[Question]:
    """Questions with a user's edits (name to fields)."""
    return [replace(q, **edits.get(q.name, {})) for q in questions]


def matched(questions: list[Question], columns: list[str]) -> tuple[dict[str, str], list[str], list[str]]:
    """(question to column, missing, extra): a column matches by the last part of its path, the first of equal ones; only
    indicators and strata can be missing."""
    by_name: dict[str, str] = {}
    for c in columns:
        by_name.setdefault(c.rpartition("/")[2], c)
    found = {q.name: by_name[q.name] for q in questions if q.name in by_name}
    used = {*found.values()}
    return found, [q.name for q in questions if q.name not in found and q.role in ("indicateur", "stratification")], [c for c in columns if c not in used]


def proportions(df: DataFrame, name: str) -> DataFrame:
    """(value, k, n, pct, ci_low, ci_high): shares of rows with a value, Wilson's interval by the exact normal quantile."""
    counts = df.where(col(name).isNotNull()).groupBy(col(name).cast("string").alias("value")).agg(F.count("*").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"), Z95)
    return counts.join(F.broadcast(counts.agg(F.sum("k").alias("n")))).select("value", "k", "n", F.round(100.0 * F.col("k") / F.col("n"), 4).alias("pct"), F.round(low, 4).alias("ci_low"), F.round(high, 4).alias("ci_high"))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != ""))


def multiple(df: DataFrame, name: str) -> DataFrame:
    """(value, k, n, pct): rows that hold each token, of rows that answered."""
    rows = df.where(col(name).isNotNull()).select(tokens(col(name).cast("string")).alias("t"))
    counts = rows.select(F.explode("t").alias("value")).groupBy("value").agg(F.count("*").alias("k"))
    return counts.join(F.broadcast(rows.agg(F.count("*").alias("n")))).select("value", "k", "n", F.round(100.0 * F.col("k") / F.col("n"), 4).alias("pct")).orderBy("value")


def univariate(df: DataFrame, question: Question, column: str) -> DataFrame | None:
    """The table of one question; none for texts, dates and identifiers."""
    if question.key in ("B", "C", "X_one"):
        return proportions(df, column)
    if question.key == "X_multi":
        return multiple(df, column)
    return numbers(df, column) if question.key in ("period",) else None


def numbers(df: DataFrame, name: str) -> DataFrame:
    """(n, normal, centre, low, high): mean and Student's interval where values look normal, else median and quartiles; from 3 values on."""
    from quaestor.functions.stats import t_quantile

    x = number(col(name))
    n, mean, std = df.agg(F.count(x), F.avg(x), F.stddev_samp(x)).first()
    schema = "n long, normal boolean, centre double, low double, high double"
    if n < 3:
        return df.sparkSession.createDataFrame([], schema)
    normal = inference.normality(df, name, policy="normal")[1]
    half = t_quantile(0.975, n - 1) * std / n**0.5
    q = None if normal else of_variables(df, {name: x}, [0.25, 0.5, 0.75]).first()["q"]
    return df.sparkSession.createDataFrame([(n, normal, mean, mean - half, mean + half) if normal else (n, normal, q[1], q[0], q[2])], schema)


def favourable(c: Column, kind: str, values: tuple[str, ...], direction: str = "") -> Column:
    """1 where the answer (or one of its tokens) is favourable, else 0; null stays null; ``negatif`` turns it round; no favourable
    values: null."""
    if not values:
        return F.lit(None).cast("int")
    hit = F.arrays_overlap(tokens(c), F.array(*map(F.lit, values))) if kind.startswith("select_multiple") else F.trim(c.cast("string")).isin(*values)
    return F.when(c.isNotNull(), (~hit if direction == "negatif" else hit).cast("int"))


def scores(df: DataFrame, questions: list[Question], columns: dict[str, str]) -> DataFrame:
    """``df`` with Score_<domain> and N_items_<domain>: 100 * favourable / answered items of the row; null without answers."""
    domains: dict[str, list[Column]] = {}
    for q in questions:
        if q.in_score and q.domain and q.name in columns and q.type.startswith("select"):
            domains.setdefault(q.domain, []).append(favourable(col(columns[q.name]), q.type, q.favourable, q.direction))
    for name, items in domains.items():
        answered = sum((i.isNotNull().cast("int") for i in items), F.lit(0))
        good = sum((F.coalesce(i, F.lit(0)) for i in items), F.lit(0))
        df = df.withColumn(f"Score_{name}", F.round(100.0 * good / F.nullif(answered, F.lit(0)), 4)).withColumn(f"N_items_{name}", answered)
    return df


def score_summary(df: DataFrame, names: list[str]) -> DataFrame:
    """(score, n, mean, median)."""
    rows = F.array(*[F.struct(F.lit(n).alias("score"), F.count(col(n)).alias("n"), F.round(F.avg(col(n)), 4).alias("mean")) for n in names])
    middle = of_variables(df, {n: col(n).cast("double") for n in names}, [0.5]).select(F.col("variable").alias("score"), F.round(F.col("q")[0], 4).alias("median"))
    return df.agg(rows.alias("x")).select(F.inline("x")).join(F.broadcast(middle), "score", "left").select("score", "n", "mean", "median")


def stratified(df: DataFrame, score: str, stratum: str, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """(figures of groups of ``least`` values or more, the test between them)."""
    return inference.group_figures(df, stratum, score, least).select("group", "n", "mean", "median"), inference.compare_groups(df, stratum, score, least)


def quality(df: DataFrame, columns: dict[str, str], numeric: list[str] = (), absent: list[str] = ()) -> DataFrame:
    """(variable, completion, missing, outliers, absent): shares of rows with a value; numbers beyond 1.5 interquartile ranges."""
    spark = df.sparkSession
    schema = "variable string, completion double, missing long, outliers long, absent boolean"
    out = spark.createDataFrame([(a, None, None, None, True) for a in absent], schema)
    if columns:
        fences = {}
        if numeric:
            found = of_variables(df, {n: number(col(columns[n])) for n in numeric}, [0.25, 0.75]).collect()  # a row for each variable
            fences = {n: (q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0])) for n, q in found}
        row = lambda n, c: F.struct(F.lit(n).alias("variable"), F.round(100.0 * F.count(col(c)) / F.nullif(F.count("*"), F.lit(0)), 1).alias("completion"), (F.count("*") - F.count(col(c))).alias("missing"), (F.when(F.count(number(col(c))) >= 4, F.coalesce(F.sum((~number(col(c)).between(*fences[n])).cast("long")), F.lit(0))).otherwise(F.lit(0)) if n in fences else F.lit(None)).cast("long").alias("outliers"), F.lit(False).alias("absent"))
        out = df.agg(F.array(*[row(n, c) for n, c in columns.items()]).alias("x")).select(F.inline("x")).unionByName(out)
    return out


def skip_anomalies(table: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(variable, depends_on, completion, parent): nearly never answered although the first variable of its condition often is."""
    first = F.regexp_extract("relevant", r"\$\{([^}]+)\}", 1)
    own = table.join(dictionary.select("variable", first.alias("depends_on")), "variable").where("depends_on != '' and completion < 5")
    return own.join(table.select(F.col("variable").alias("depends_on"), F.col("completion").alias("parent")), "depends_on").where("parent >= 50").select("variable", "depends_on", "completion", "parent")


def analysis(df: DataFrame, questions: list[Question]) -> dict:
    """All steps: columns matched, tables of questions, scores and their relations, strata, quality."""
    found, missing, extra = matched(questions, df.columns)
    by_name = {q.name: q for q in questions}
    scored = scores(df, questions, found)
    names = [c for c in scored.columns if c.startswith("Score_")]
    strata = [q.name for q in questions if q.role == "stratification" and q.key == "X_one" and q.name in found]
    numeric = [n for n in found if by_name[n].key == "period"]
    return {
        "matched": found, "missing": missing, "extra": extra, "univariate": {n: t for n, c in found.items() if by_name[n].role != "exclu" and (t := univariate(df, by_name[n], c)) is not None},
        "scores": scored, "summary": score_summary(scored, names) if names else None, "spearman": inference.spearman(scored, names) if len(names) > 1 else None,
        "stratified": {(s, v): stratified(scored, s, found[v]) for s in names for v in strata}, "quality": quality(df, found, numeric, missing),
    }
