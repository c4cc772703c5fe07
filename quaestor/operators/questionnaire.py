"""Questionnaire metadata: radicals from labels, cleaning of coded items, skip rules and forms. Items are few; expressions over
columns exist where texts are many."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions.exprs import form_name, sanitized, unmarked

# French words that carry no meaning in a label.
STOP_WORDS = (
    "le la les l un une des du de d au aux votre vos mon ma mes son sa ses notre nos leur leurs ce cet cette ces je tu il elle nous vous ils elles on y me te se lui moi toi soi eux "
    "quel quelle quels quelles comment combien pourquoi quand ou qui que qu quoi est sont etre ete etais etait etiez etions etaient soit soient a as ai avez avons avoir aurez aurai auront avais avait avaient "
    "fait faites font faire faut peut peuvent pouvez peux pouvoir doit doivent devez devons devoir sait savez savons savoir va vas vont allez allons aller viens venez vient viennent venir "
    "trouve trouvez trouvent trouvons trouver situe situee situees situes situer en sur sous par pour avec sans rapport vers envers dans chez entre depuis pendant apres avant contre selon dont "
    "et mais donc or ni car si parce tant aussi meme tres plus moins ne pas non jamais rien aucun aucune nul nulle oui autre autres divers memes lieu cas fois temps partie type moyen manière facon"
).split()
OPTIONS = re.compile(r"(\w+_)\s*=\s*\[([^\]]+)\]")
RANGE = re.compile(r"(\d+(?:\.\d+)?)\s*<\s*[A-Za-z]\s*<\s*(\d+(?:\.\d+)?)")


def radical_from_label(label: Column, most: int = 4) -> Column:
    """The first meaningful words of a label, capitalised and joined by underscores; empty where there are none."""
    s = unmarked(F.lower(label))
    for pattern in (r"\([^)]*\)", r"\[[^\]]*\]", "[?!.,;:'\"\\-—–«»]"):
        s = F.regexp_replace(s, pattern, " ")
    words = F.filter(F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " "), lambda w: (F.char_length(w) >= 2) & ~w.isin(*STOP_WORDS))
    return F.array_join(F.transform(F.slice(words, 1, most), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "_")


def skip_rule(rule: Column) -> Column:
    """A form's condition for rules joined by ``;``: negation, inequality (above 0 for numbers), equality or a bare name."""

    def one(r: Column) -> Column:
        c = F.trim(F.substring_index(r, "->", 1))
        bare, unlike, like = c.rlike(r"^!\s*\S") & ~c.contains("="), c.rlike(r"^\S+\s*!=\s*.+$"), c.rlike(r"^\S+\s*=\s*.+$")
        name = lambda x: F.concat(F.lit("${"), form_name(F.trim(F.regexp_replace(x, "^!", ""))), F.lit("}"))
        value = lambda p: F.trim(F.regexp_extract(c, p, 2))
        no, yes = value(r"^(\S+?)\s*!=\s*(.+)$"), value(r"^(\S+?)\s*=\s*(.+)$")
        return (
            F.when(bare, F.concat(name(F.regexp_extract(c, r"^!\s*(\S+)", 1)), F.lit(" = 'non'")))
            .when(unlike, F.concat(name(F.regexp_extract(c, r"^(\S+?)\s*!=", 1)), F.when(no.rlike(r"^\d+$"), F.lit(" > 0")).otherwise(F.concat(F.lit(" != '"), sanitized(F.lower(no)), F.lit("'")))))
            .when(like, F.concat(name(F.regexp_extract(c, r"^(\S+?)\s*=", 1)), F.lit(" = '"), sanitized(F.lower(yes)), F.lit("'")))
            .otherwise(F.concat(name(c), F.lit(" = 'oui'")))
        )

    parts = F.filter(F.transform(F.split(F.coalesce(rule, F.lit("")), r"\s*;\s*"), lambda r: F.trim(r)), lambda r: (r != "") & (F.trim(F.substring_index(r, "->", 1)) != ""))
    return F.array_join(F.transform(parts, one), " and ")


def suspect(radical: Column) -> Column:
    """Radicals that begin with a question word or hold a verb of place."""
    return F.coalesce(radical == "", F.lit(True)) | radical.rlike(r"(?i)^(Quel(?:le)?s?|Combien|Comment|Pourquoi|Quand|Ou|Avez_Vous|Est_Ce_Que)_") | radical.rlike(r"(?i)(_Trouvez?_|_Se_Trouve)")


def tidy_radical(radical: Column, label: Column) -> Column:
    """A suspect radical is made anew from the label; question words and one-letter parts go; never empty."""
    new = radical_from_label(label)
    r = F.when(suspect(radical) & (F.char_length(new) >= 4), new).otherwise(radical)
    for pattern in (r"(?i)^Quel(?:le)?s?_", r"(?i)^Combien_(de_|d_)?", r"(?i)^Pourquoi_", r"(?i)^Comment_", r"(?i)^Quand_", r"(?i)^Ou_", r"(?i)^Avez_Vous_", r"(?i)^Est_Ce_Que_"):
        r = F.regexp_replace(r, pattern, "")
    r = F.regexp_replace(F.regexp_replace(r, r"(?i)_Trouvez?_", "_"), r"(?i)_Se_Trouve(_|$)", "$1")
    r = F.array_join(F.filter(F.split(r, "_"), lambda s: (F.char_length(s) >= 2) | s.rlike(r"^\d")), "_")
    return F.when(r == "", radical).otherwise(r)


def learned(old: DataFrame, batch: DataFrame, key: str = "code", longest: int = 500) -> DataFrame:
    """Old items and those of ``batch`` with a new key, texts cut to ``longest``; an old item wins, repeats within a batch stay."""
    cut = batch.select([F.substring(c, 1, longest).alias(c) if t == "string" else F.col(c) for c, t in batch.dtypes])
    return old.unionByName(cut.join(old.select(key), key, "left_anti").select(old.columns))


def first_json(text: Column, path: str) -> Column:
    """A field of the JSON object that a text holds, whatever surrounds it; null where there is none."""
    return F.get_json_object(F.regexp_extract(text, r"(?s)(\{.*\})", 1), path)


def plain(text: str) -> str:
    """A form field's name, on the driver."""
    s = "".join(c for c in unicodedata.normalize("NFD", text or "") if not "̀" <= c <= "ͯ")
    s = re.sub("_+", "_", re.sub("[^a-zA-Z0-9_]", "_", s)).strip("_")[:63]
    return s or "field"


def field_name(code: str) -> str:
    s = re.sub("[^a-zA-Z0-9_]", "", code.replace("__", "_"))
    return s[:63] if s[:1].isalpha() and s[:1].isascii() else "q_" + s[:61]


def condition(rule: str) -> str:
    """``skip_rule`` on the driver."""
    out = []
    for part in re.split(r"\s*;\s*", rule or ""):
        c = part.split("->")[0].strip()
        if not c:
            continue
        if m := re.match(r"!\s*(\S+)", c) if "=" not in c else None:
            out.append(f"${{{field_name(m[1])}}} = 'non'")
        elif m := re.match(r"(\S+?)\s*!=\s*(.+)$", c):
            out.append(f"${{{field_name(m[1])}}} > 0" if m[2].strip().isdigit() else f"${{{field_name(m[1])}}} != '{plain(m[2].strip().lower())}'")
        elif m := re.match(r"(\S+?)\s*=\s*(.+)$", c):
            out.append(f"${{{field_name(m[1])}}} = '{plain(m[2].strip().lower())}'")
        else:
            out.append(f"${{{field_name(c.removeprefix('!'))}}} = 'oui'")
    return " and ".join(out)


def form(items: list[dict], title: str = "Questionnaire", version: str = "1") -> dict[str, list[dict]]:
    """survey, choices and settings of coded items (libelle, pf_question, pf_modalites, pf_skip).

    Types: yes/no for ``__B``, a list for ``__X`` (one answer where options are parted by commas or the code says 1*1, else
    several) and ``__SRC`` (several), numbers, dates, texts. Lists of districts (REGION-DISTRICT) follow the last region asked.
    """
    survey, choices, region = [], {"yes_no": [{"name": "oui", "label": "Oui"}, {"name": "non", "label": "Non"}]}, None
    for number, item in enumerate(items, 1):
        code, _, extra = item["pf_question"].partition("!")
        options = OPTIONS.search(item.get("pf_modalites") or "")
        name, kind, limit, message, choice = field_name(code), "text", "", "", ""
        key = plain(options[1].rstrip("_").lower()) if options else ""
        listed = [s.strip() for s in re.split(r"\|" if "|" in options[2] else ",", options[2]) if s.strip()] if options else []
        if "__B" in code or extra == "boolean":
            kind = "select_one yes_no"
        elif "__SRC" in code:
            kind = f"select_multiple {key}" if key else "text"
        elif "__X" in code:
            one = not options or "|" not in options[2] or "1*1" in extra or "district" in key
            kind = ("select_one " if one else "select_multiple ") + (key or "yes_no")
            if "district" in key and region:
                choice = f"region_code=${{{region}}}"
            elif "region" in key:
                region = name
        elif re.search(r"__2[A-Z]?$", code):
            kind = "decimal"
        elif re.search(r"__1([YMWDHU]|[^A-Za-z]|$)", code):
            kind = "integer"
        elif "__A" in code:
            kind = "date"
        if not kind.startswith("select") and kind != "date" and "__Z" not in code and (m := RANGE.search(extra)):
            low, high = float(m[1]), float(m[2])
            kind = "integer" if kind == "text" else kind
            limit, message = f"{'. >= ' if low == 0 else '. > '}{low:g} and . < {high:g}", f"Valeur entre {low:g} et {high:g}"
        if key and key not in choices and kind.startswith("select"):
            pairs = [(o.partition("-")[0].strip(), o.partition("-")[2].strip() or o) for o in listed]
            choices[key] = [{"name": plain(d.lower()), "label": d, "region_code": plain(r.lower())} for r, d in pairs] if "district" in key else [{"name": plain(o.lower()), "label": o} for o in listed]
        survey.append({"type": kind, "name": name, "label": item.get("libelle", ""), "required": "yes", "relevant": condition(item.get("pf_skip") or ""), "constraint": limit, "constraint_message": message, "choice_filter": choice, "hint": item.get("pf_modalites") or "", "number": number})
    rows = [{"list_name": k} | c for k, v in choices.items() for c in v]
    return {"survey": survey, "choices": rows, "settings": [{"form_title": title, "form_id": re.sub("_+", "_", re.sub("[^a-z0-9]", "_", plain(title).lower())), "version": version, "default_language": "French (fr)", "style": "pages"}]}


def repaired_json(text: str) -> dict | None:
    """The object of a model's reply: fences are taken off, text around it is left out, a cut reply is closed."""
    raw = re.sub(r"```json\n?|\n?```", "", text).strip()
    inner = re.search(r"\{[\s\S]*\}", raw)
    cut = raw[: raw.rfind("}") + 1]
    for candidate in (raw, inner[0] if inner else "", cut + "]}", cut + "}"):
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def lines_of_cells(cells: list[list[str]]) -> list[str]:
    """Questions of a sheet's cells: the column headed by a word for question in the first five rows, else the first; the
    choices' column in brackets."""
    for k, row in enumerate(cells[:5]):
        low = [str(c or "").lower() for c in row]
        q = next((j for j, c in enumerate(low) if re.search("question|libell|intitul", c)), None)
        if q is not None:
            m = next((j for j, c in enumerate(low) if re.search("modalit|r[ée]ponse|choix|option", c) and j != q), None)
            return [f"{r[q]}" + (f"   [{r[m]}]" if m is not None and m < len(r) and r[m] else "") for r in cells[k + 1 :] if q < len(r) and r[q]]
    return [str(r[0]) for r in cells if r and r[0]]
