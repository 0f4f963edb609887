"""SQL statements of the expected results, for another engine to check the Spark ones."""

from __future__ import annotations

from tamis.functions import fixed, text
from tamis.plans.views import sales_sql, staff_sql

TEXT, NUMBER, MOMENT = "t", "n", "d"

STAFF = {
    "cle": NUMBER, "id": TEXT, "email": TEXT, "tel": TEXT, "prenom": TEXT, "nir": TEXT, "iban": TEXT,
    "service": TEXT, "salaire": NUMBER, "anciennete": NUMBER, "a_quitte": NUMBER, "pays": TEXT,
    "commentaire": TEXT,
}
SALES = {
    "ordre": NUMBER, "id_vente": TEXT, "cle": NUMBER, "date_vente": TEXT, "client": TEXT, "montant": NUMBER,
    "statut": TEXT,
}
EVENTS = {
    "event_id": NUMBER, "ts": MOMENT, "user_id": NUMBER, "event_type": TEXT, "value": NUMBER, "props": TEXT,
}
LINEITEM = {
    "l_orderkey": NUMBER, "l_partkey": NUMBER, "l_suppkey": NUMBER, "l_linenumber": NUMBER,
    "l_quantity": NUMBER, "l_extendedprice": NUMBER, "l_discount": NUMBER, "l_tax": NUMBER,
    "l_returnflag": TEXT, "l_linestatus": TEXT, "l_shipdate": MOMENT,
}
ORDERS_NUMBERS = {"o_orderkey": NUMBER, "o_custkey": NUMBER, "o_totalprice": NUMBER}


def quoted_list(words) -> str:
    return ", ".join("'" + word.replace("'", "''") + "'" for word in words)


def shape(value: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({value}, '{pattern}') THEN '{name}'" for name, pattern, _ in fixed.DATE_SHAPES)
    return f"(CASE {cases} END)"


def shown(value: str) -> str:
    line = f"trim(regexp_replace({value}, '[{text.BLANKS}]+', ' ', 'g'))"
    return f"(CASE WHEN length({line}) <= 80 THEN {line} ELSE concat(left({line}, 79), '…') END)"


def melted(table: str, columns: dict[str, str], order: str) -> str:
    """CTE body with a row per cell: (pos, nom, fam, ordre, v, d)."""
    parts = []
    for i, (name, kind) in enumerate(columns.items()):
        number = f"CAST({name} AS DOUBLE)" if kind == NUMBER else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT {i} AS pos, '{name}' AS nom, '{kind}' AS fam, {order} AS rangee, "
            f"CAST({name} AS VARCHAR) AS v, {number} AS d FROM {table}"
        )
    return " UNION ALL ".join(parts)


def profiled(cells: str) -> str:
    """CTEs from ``m`` (the cells) to ``prof``: one row per column with everything a profile says."""
    return f"""
    m AS ({cells}),
    mes AS (
      SELECT pos, nom, any_value(fam) AS fam, count(*) AS nb, count(v) AS n, count(*) - count(v) AS manq,
        count(DISTINCT v) AS dis, count(DISTINCT trim(v)) AS st, count(DISTINCT lower(trim(v))) AS fo,
        bool_and(lower(trim(v)) IN ({quoted_list(fixed.BOOLEAN_WORDS)})) AS boo,
        count({shape('trim(v)')}) / greatest(count(v), 1) AS dat, count(DISTINCT {shape('trim(v)')}) AS sh,
        min(d) AS mi, max(d) AS ma, avg(d) AS mo, stddev_pop(d) AS ec,
        quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.5) AS q2, quantile_cont(d, 0.75) AS q3,
        bool_and(d = floor(d)) AS wh, bool_and(d IN (0, 1)) AS bi
      FROM m GROUP BY pos, nom),
    ext AS (
      SELECT m.pos, count(*) AS extremes FROM m JOIN mes ON m.pos = mes.pos
      WHERE q3 <> q1 AND (d < q1 - 1.5 * (q3 - q1) OR d > q3 + 1.5 * (q3 - q1)) GROUP BY m.pos),
    lab AS (
      SELECT mes.*, coalesce(extremes, 0) AS extremes, CASE
        WHEN n = 0 THEN 'texte' WHEN fam = 'd' THEN 'date'
        WHEN fam = 'n' AND wh AND bi THEN 'booléen'
        WHEN fam = 'n' AND wh AND dis / n >= 0.98 THEN 'identifiant'
        WHEN fam = 'n' AND wh THEN 'entier' WHEN fam = 'n' THEN 'décimal'
        WHEN boo THEN 'booléen' WHEN dat > 0.8 THEN 'date' WHEN st / n >= 0.9 THEN 'identifiant'
        WHEN st <= greatest(20, n * 0.05) THEN 'catégorie' ELSE 'texte' END AS type
      FROM mes LEFT JOIN ext ON mes.pos = ext.pos),
    col AS (
      SELECT *, CASE
        WHEN type = 'date' AND sh > 1 THEN concat('formats_multiples: ', sh, ' écritures de date coexistent dans la colonne.')
        WHEN type IN ('entier', 'décimal') AND extremes > 0
          THEN concat('valeurs_extremes: ', extremes, ' valeur(s) très éloignée(s) du reste de la colonne.')
        WHEN type IN ('catégorie', 'texte') AND dis > fo
          THEN concat('modalites_variantes: ', dis - fo, ' modalité(s) ne diffèrent que par la casse ou les espaces.')
        END AS anomalie,
        round(manq / nb, 4) AS part
      FROM lab),
    freq AS (SELECT pos, v, count(*) AS k FROM m WHERE v IS NOT NULL GROUP BY pos, v),
    top AS (SELECT pos, v, k, row_number() OVER (PARTITION BY pos ORDER BY k DESC, v) AS r FROM freq QUALIFY r <= 5),
    modal AS (SELECT pos, string_agg(concat({shown('v')}, ' × ', k), ' | ' ORDER BY r) AS modalites FROM top GROUP BY pos),
    firsts AS (SELECT pos, v, row_number() OVER (PARTITION BY pos ORDER BY rangee) AS r FROM m WHERE v IS NOT NULL QUALIFY r <= 3),
    exa AS (SELECT pos, string_agg({shown('v')}, ' | ' ORDER BY r) AS exemples FROM firsts GROUP BY pos),
    prof AS (
      SELECT col.pos, nom, type, manq AS valeurs_manquantes, part AS part_manquantes, dis AS cardinalite,
        coalesce(exemples, '') AS exemples,
        CASE WHEN type IN ('entier', 'décimal') THEN round(mi, 2) END AS minimum,
        CASE WHEN type IN ('entier', 'décimal') THEN round(ma, 2) END AS maximum,
        CASE WHEN type IN ('entier', 'décimal') THEN round(mo, 2) END AS moyenne,
        CASE WHEN type IN ('entier', 'décimal') THEN round(q2, 2) END AS mediane,
        CASE WHEN type IN ('entier', 'décimal') THEN round(ec, 2) END AS ecart_type,
        CASE WHEN type NOT IN ('entier', 'décimal') THEN modalites END AS modalites,
        anomalie
      FROM col LEFT JOIN modal ON col.pos = modal.pos LEFT JOIN exa ON col.pos = exa.pos)"""


def scored(table: str) -> str:
    """CTEs after ``profiled``: ``pen`` (penalties in order) and ``note`` (score, rows, duplicates)."""
    return f"""
    dup AS (SELECT (SELECT count(*) FROM {table}) AS nb, (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS di),
    tot AS (SELECT count(*) AS w, avg(part) AS miss, count(*) FILTER (part > 0.5) AS vides,
      count(*) FILTER (dis <= 1) AS fixes, count(anomalie) AS touchees FROM col),
    pen AS (
      SELECT 1 AS i, 'Valeurs manquantes' AS critere, -round(miss * 40, 1) AS impact,
        printf('%.1f%% des valeurs sont absentes en moyenne par colonne.', round(miss * 100, 1)) AS detail FROM tot
      UNION ALL SELECT 2, 'Lignes en double', -round(round((nb - di) / nb, 4) * 30, 1),
        printf('%d ligne(s) identique(s) a une autre, soit %.1f%%.', nb - di, round(round((nb - di) / nb, 4) * 100, 1)) FROM dup
      UNION ALL SELECT 3, 'Colonnes quasi vides', -round(round(vides / w, 4) * 20, 1),
        printf('%d colonne(s) a plus de la moitie de valeurs absentes.', vides) FROM tot
      UNION ALL SELECT 4, 'Colonnes sans variation', -round(round(fixes / w, 4) * 10, 1),
        printf('%d colonne(s) ne contiennent qu''une seule valeur.', fixes) FROM tot
      UNION ALL SELECT 5, 'Incohérences de saisie', -round(round(touchees / w, 4) * 35, 1),
        printf('%d colonne(s) présentent des formats mélangés, des modalités variantes ou des valeurs extrêmes.', touchees) FROM tot),
    note AS (
      SELECT round(greatest(0, least(100, 100 + coalesce(sum(impact), 0))), 1) AS score,
        string_agg(concat(critere, ' (', printf('%.1f', impact), ') : ', detail), ' | ' ORDER BY i) AS raisons
      FROM pen WHERE impact < 0)"""


def over(ctes: list[str], query: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + query


def per_table(builder, tables: dict[str, tuple[list[str], str, dict[str, str], str]]) -> str:
    """UNION ALL of one statement per table, each with its own CTEs."""
    return " UNION ALL ".join(f"SELECT * FROM ({builder(name, *spec)})" for name, spec in tables.items())


STAFF_SPEC = ([staff_sql()], "staff", STAFF, "cle")
SALES_SPEC = ([sales_sql()], "sales", SALES, "ordre")
EVENTS_SPEC = ([], "events", EVENTS, "event_id")
LINEITEM_SPEC = ([], "lineitem", LINEITEM, "l_orderkey")
BOTH = {"staff": STAFF_SPEC, "sales": SALES_SPEC}


def profile_statement(select: str, name: str, ctes: list[str], table: str, columns: dict[str, str], order: str, score: bool = False) -> str:
    body = [*ctes, profiled(melted(table, columns, order))]
    if score:
        body.append(scored(table))
    return over(body, select.replace("{name}", f"'{name}'"))


# --- Personal data ------------------------------------------------------------------------

_FOLD = "lower(strip_accents(split_part(trim(v), ' ', 1)))"


def detections(cells: str) -> str:
    """CTEs from ``m`` to ``det``: (pos, nom, type_pii, confiance, exemple_masque)."""
    names = quoted_list(sorted({name.lower() for name in fixed.FIRST_NAMES + fixed.LAST_NAMES}))
    return f"""
    m AS ({cells}),
    taux AS (
      SELECT pos, nom,
        avg(CASE WHEN regexp_matches(trim(v), '(?i)^[^@\\s]+@[^@\\s]+\\.[a-z]{{2,}}$') THEN 1.0 ELSE 0 END) AS t1,
        avg(CASE WHEN regexp_matches(trim(v), '^(0[1-9][0-9]{{8}}|\\+33[1-9][0-9]{{8}})$') THEN 1.0 ELSE 0 END) AS t2,
        avg(CASE WHEN regexp_matches(trim(v), '(?i)^FR[0-9]{{2}}[0-9A-Z]{{23}}$') THEN 1.0 ELSE 0 END) AS t3,
        avg(CASE WHEN regexp_matches(trim(v), '^[0-9]{{13,15}}$') THEN 1.0 ELSE 0 END) AS t4,
        coalesce(avg(CASE WHEN {_FOLD} IN ({names}) THEN 1.0 ELSE 0 END) FILTER (trim(v) <> ''), 0) AS t5
      FROM m WHERE v IS NOT NULL GROUP BY pos, nom),
    det AS (
      SELECT pos, nom,
        CASE WHEN t1 >= 0.8 THEN 'adresse e-mail' WHEN t2 >= 0.8 THEN 'téléphone' WHEN t3 >= 0.8 THEN 'IBAN'
          WHEN t4 >= 0.8 THEN 'numéro de sécurité sociale' WHEN t5 >= 0.5 THEN 'nom de personne' END AS type_pii,
        round(CASE WHEN t1 >= 0.8 THEN t1 WHEN t2 >= 0.8 THEN t2 WHEN t3 >= 0.8 THEN t3 WHEN t4 >= 0.8 THEN t4 ELSE t5 END, 3) AS confiance,
        CASE WHEN t1 >= 0.8 THEN 'email_001@masked.local' WHEN t2 >= 0.8 THEN 'TEL_001' WHEN t3 >= 0.8 THEN 'IBAN_001'
          WHEN t4 >= 0.8 THEN 'NIR_001' ELSE 'PERS_001' END AS exemple_masque
      FROM taux)"""


PERSONAL = {
    "email": ("adresse e-mail", "email_%03d@masked.local"),
    "tel": ("téléphone", "TEL_%03d"),
    "prenom": ("nom de personne", "PERS_%03d"),
    "nir": ("numéro de sécurité sociale", "NIR_%03d"),
    "iban": ("IBAN", "IBAN_%03d"),
}


def token_ctes() -> str:
    """CTE ``jet``: (colonne, v, empreinte, jeton) for the personal columns of the staff view."""
    parts = [
        f"SELECT '{name}' AS colonne, {name} AS v, sha256({name}) AS empreinte, "
        f"printf('{form}', row_number() OVER (ORDER BY min(cle))) AS jeton "
        f"FROM staff WHERE {name} IS NOT NULL GROUP BY {name}"
        for name, (_, form) in PERSONAL.items()
    ]
    return "jet AS (" + " UNION ALL ".join(parts) + ")"
