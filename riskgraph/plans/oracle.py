"""DuckDB SQL for the catalogue's queries, written from their definitions."""

from __future__ import annotations

from riskgraph.sources import generator

EV = """ev AS (SELECT event_id AS seq,
  CASE event_type WHEN 'purchase' THEN 'TRANSACTION' WHEN 'click' THEN 'EMAIL' WHEN 'view' THEN 'SMS'
    WHEN 'error' THEN 'LOG_ACCES' WHEN 'signup' THEN 'APPROBATION' END AS type_evenement,
  CASE WHEN event_id % 10 = 0 THEN 'INCONNU' WHEN event_id % 2 = 0 THEN 'INTERNE' ELSE 'EXTERNE' END AS type_source,
  ts AS horodatage, epoch_us(ts) AS t, value AS montant, user_id AS src,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS dst,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) / 100.0 AS corroboration,
  event_id % 7 AS sources, event_id % 4 AS jump FROM events)"""


def _edges(name: str) -> str:
    return (
        f"{name} AS (SELECT DISTINCT user_id AS src, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS dst "
        f"FROM events WHERE event_type = 'purchase' AND user_id <> CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT))"
    )


def _both(name: str, edges: str) -> str:
    return f"{name} AS (SELECT src, dst FROM {edges} UNION ALL SELECT dst, src FROM {edges})"


def _components(name: str, edges: str) -> str:
    return (
        f"{name}_r(id, node) AS ((SELECT src, src FROM {edges} UNION SELECT dst, dst FROM {edges}) "
        f"UNION SELECT r.id, s.dst FROM {name}_r r JOIN (SELECT src, dst FROM {edges} UNION ALL SELECT dst, src FROM {edges}) s ON r.node = s.src), "
        f"{name} AS (SELECT id, min(node) AS id_communaute FROM {name}_r GROUP BY id)"
    )


E = _edges("e")
P = _edges("p")


def _chain(as_of: str, windowed: bool) -> str:
    """CTEs ev -> v (motif, flags) of the validators."""
    age = f"CAST(floor((epoch(TIMESTAMP '{as_of}') - floor(epoch(horodatage))) / 86400) AS BIGINT)"
    outlier = (
        """h AS (SELECT *, list_sort(coalesce(list(montant) OVER (ORDER BY seq ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING), [])) AS past
  FROM x WHERE type_evenement = 'TRANSACTION' AND montant IS NOT NULL AND r1 IS NULL AND r2 IS NULL AND r5 IS NULL AND r6 IS NULL),
o AS (SELECT seq, len(past) >= 10 AND past[len(past) // 2 + 1] > 0 AND montant > 5.0 * past[len(past) // 2 + 1] AS is_outlier FROM h),"""
        if windowed
        else "o AS (SELECT seq, false AS is_outlier FROM x),"
    )
    return f"""{EV},
x AS (SELECT *,
  CASE WHEN coalesce(type_evenement, '') NOT IN ('TRANSACTION','EMAIL','SMS','LOG_ACCES','APPROBATION','PARTAGE_IP','COSIGNATURE','PARTAGE_ADRESSE')
    THEN 'Type non autorisé : ''' || coalesce(type_evenement, '') || '''' END AS r1,
  CASE WHEN type_source NOT IN ('INTERNE','EXTERNE') THEN 'Source non autorisée : ''' || type_source || '''' END AS r2,
  CASE WHEN horodatage IS NULL THEN 'Horodatage manquant' WHEN {age} > 180
    THEN 'Rétrodatation excessive : ' || {age} || ' jours > 180 jours' END AS r5,
  CASE WHEN {age} > 30 THEN 'RETRODATE_MODEREE' END AS f5,
  CASE WHEN sources > 5 THEN 'Nombre de sources excessif : ' || sources END AS r6,
  CASE WHEN coalesce(corroboration, 0) < 0.33 THEN 'FAIBLE_CORROBORATION' END AS f6,
  CASE WHEN jump > 2 THEN 'Saut hiérarchique excessif : ' || jump END AS r8 FROM ev),
{outlier}
v AS (SELECT x.*, coalesce(r1, r2, r5, r6, r8) AS motif, list_filter([
  CASE WHEN coalesce(r1, r2, r5) IS NULL THEN f5 END, CASE WHEN coalesce(r1, r2, r5, r6) IS NULL THEN f6 END,
  CASE WHEN coalesce(is_outlier, false) AND coalesce(r1, r2, r5, r6) IS NULL THEN 'MONTANT_ABERRANT' END], lambda f: f IS NOT NULL) AS flags
  FROM x LEFT JOIN o USING (seq))"""


PATHS = """pp AS (SELECT src, dst FROM p UNION ALL
  SELECT a.src, b.dst FROM p a JOIN p b ON a.dst = b.src WHERE NOT (a.src = b.src AND a.dst = b.dst))"""


def _rank(rounds: int) -> str:
    out = f"""{PATHS}, pm AS (SELECT src, dst, count(*) AS mult FROM pp GROUP BY 1, 2),
po AS (SELECT src, sum(mult) AS o FROM pm GROUP BY 1), pl AS (SELECT src, dst, o FROM pm JOIN po USING (src)),
pn AS (SELECT src AS id FROM pl UNION SELECT dst FROM pl), pc AS (SELECT count(*) AS n FROM pn),
r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM pn, pc)"""
    for i in range(1, rounds + 1):
        out += f""",
r{i} AS (SELECT pn.id, 0.15::DOUBLE / n + 0.85 * coalesce(g.got, 0) AS rank FROM pn CROSS JOIN pc LEFT JOIN
  (SELECT dst, sum(rank / o) AS got FROM pl JOIN r{i - 1} ON src = id GROUP BY 1) g ON g.dst = pn.id)"""
    return out


JACCARD = f"""{_both('nb', 'e')}, nd AS (SELECT DISTINCT src, dst FROM nb), dg AS (SELECT src AS v, count(*) AS d FROM nd GROUP BY 1),
jc AS (SELECT e.src, e.dst, count(y.dst) AS c FROM e JOIN nd x ON x.src = e.src LEFT JOIN nd y ON y.src = e.dst AND y.dst = x.dst GROUP BY 1, 2),
jac AS (SELECT jc.src, jc.dst, CASE WHEN a.d + b.d - c = 0 THEN 0 ELSE c / (a.d + b.d - c) END AS jaccard
  FROM jc JOIN dg a ON a.v = jc.src JOIN dg b ON b.v = jc.dst)"""
CONFIDENCE = f"""{JACCARD}, facts AS (SELECT src, dst, count(*) AS n, max(horodatage) AS last_seen, count(DISTINCT type_evenement) AS kinds,
  avg(corroboration) AS corr FROM ev GROUP BY 1, 2),
conf AS (SELECT e.src, e.dst, last_seen, round(least(1, greatest(0,
  0.25 * least(1, ln(1 + coalesce(n, 0)) / ln(101)) + 0.20 * exp(-0.005 * coalesce(floor((epoch(TIMESTAMP '2024-02-15') - floor(epoch(last_seen))) / 86400), 0))
  + 0.20 * least(1, coalesce(kinds, 0) / 5.0) + 0.20 * coalesce(jaccard, 0) + 0.15 * least(1, greatest(0, coalesce(corr, 0))))), 6) AS score_confiance
  FROM e LEFT JOIN facts USING (src, dst) LEFT JOIN jac USING (src, dst))"""
VERT = "vt AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"
RISK = """rv AS (SELECT vt.id, fmod(abs(c_acctbal), 100.0) / 100.0 AS risk FROM vt LEFT JOIN customer ON c_custkey = vt.id)"""
GNN = """gn AS (SELECT src AS id, sum(coalesce(score_confiance, 0.5) * coalesce(risk, 0.1)) AS num, sum(coalesce(score_confiance, 0.5)) AS den
  FROM conf JOIN rv ON rv.id = conf.dst GROUP BY 1),
gnn AS (SELECT rv.id, round(least(1, greatest(0, CASE WHEN den IS NOT NULL AND den <= 0 THEN coalesce(risk, 0.1)
  ELSE coalesce(risk, 0.1) * 0.25 + CASE WHEN den IS NULL THEN 0.1 ELSE num / den END * 0.75 END)), 6) AS score_gnn FROM rv LEFT JOIN gn USING (id))"""
HUBS = """dr AS (SELECT src AS id, count(*) AS d FROM nb GROUP BY 1), dv AS (SELECT vt.id, coalesce(d, 0) AS degre FROM vt LEFT JOIN dr USING (id)),
th AS (SELECT avg(degre) * 3.0 AS threshold FROM dv), hub AS (SELECT id, degre, threshold, degre >= threshold AS est_hub FROM dv, th)"""
COHESION = """sz AS (SELECT id_communaute, count(*) AS size FROM cp GROUP BY 1),
ins AS (SELECT a.id_communaute, count(*) AS inside FROM p JOIN cp a ON a.id = p.src JOIN cp b ON b.id = p.dst
  WHERE a.id_communaute = b.id_communaute AND p.src <> p.dst GROUP BY 1),
coh AS (SELECT id_communaute, size, round(CASE WHEN size < 2 THEN 0 ELSE 2.0 * coalesce(inside, 0) / (size * (size - 1)) END, 6) AS cohesion
  FROM sz LEFT JOIN ins USING (id_communaute))"""
#: Communities: the customers' nations; and an earlier snapshot of them.
GROUPS = f"""{_edges('ge')}, gv AS (SELECT src AS id FROM ge UNION SELECT dst FROM ge),
cp AS (SELECT id, c_nationkey::BIGINT AS id_communaute FROM gv JOIN customer ON c_custkey = id)"""
BEFORE = """cq AS (SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN c_nationkey::BIGINT ELSE (c_nationkey::BIGINT + 1) % 25 END AS id_communaute
  FROM customer WHERE c_mktsegment <> 'BUILDING')"""
CLASS = "CASE WHEN cohesion < 0.05 THEN 'DIFFUSE' WHEN cohesion < 0.30 THEN 'NORMALE' WHEN cohesion < 0.60 THEN 'DENSE' ELSE 'TRES_DENSE' END"
CREATED = "cr AS (SELECT user_id AS id, min(ts) AS date_creation FROM events GROUP BY 1)"
EVOLUTION = """ej AS (SELECT cp.id_communaute, cp.id, cq.id_communaute AS earlier FROM cp LEFT JOIN cq USING (id)),
ee AS (SELECT id_communaute, count(*) AS size, count(earlier) AS known, count(DISTINCT earlier) AS sources FROM ej GROUP BY 1),
evo AS (SELECT *, CASE WHEN known = 0 THEN 'NOUVELLE' WHEN sources >= 5 THEN 'FRAGMENTEE_SUSPECTE' WHEN sources > 1 THEN 'FUSIONNEE'
  WHEN known / size >= 0.70 THEN 'STABLE' WHEN known / size >= 0.30 THEN 'EN_TRANSITION' ELSE 'REORGANISEE' END AS evolution FROM ee)"""


def _core(density: float) -> str:
    return f"""og AS (SELECT cp.id, cp.id_communaute FROM cp JOIN cr USING (id) WHERE date_creation < TIMESTAMP '2024-02-15' - INTERVAL 30 DAY),
oz AS (SELECT id_communaute, count(*) AS n FROM og GROUP BY 1),
oi AS (SELECT a.id_communaute, count(*) AS inside FROM p JOIN og a ON a.id = p.src JOIN og b ON b.id = p.dst WHERE a.id_communaute = b.id_communaute GROUP BY 1),
ok AS (SELECT id_communaute FROM oz LEFT JOIN oi USING (id_communaute) WHERE n < 2 OR round(2.0 * coalesce(inside, 0) / (n * (n - 1)), 6) >= {density}),
core AS (SELECT id_communaute, id FROM og WHERE id_communaute IN (SELECT id_communaute FROM ok))"""


def _plain(column: str) -> str:
    """Normalised text; sharp s becomes one byte, as DuckDB's edit distance counts bytes."""
    return f"replace(strip_accents(lower(trim(coalesce({column}, '')))), 'ß', chr(1))"


NAMES = f"""nm AS (SELECT p_partkey AS id, {_plain('p_name')} AS x, {_plain('p_brand')} AS s FROM part)"""
TURNS = f"""nm AS (SELECT conv_id, turn, {_plain('text')} AS x, {_plain('role')} AS s FROM conversations)"""


def _uniform(seed: int, name: str, *keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{name}', {', '.join(f'{k}::VARCHAR' for k in keys)})), 1, 13))::BIGINT / {float(1 << 52)!r})"


def _edit(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 "
        f"ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END"
    )


def _prefix(a: str, b: str) -> str:
    tests = " + ".join(f"(substr(rpad(left({a}, 4), 4, '0'), {i}, 1) = substr(rpad(left({b}, 4), 4, '0'), {i}, 1))::INT" for i in range(1, 5))
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE ({tests}) / 4.0 END"


BLOCKS = f"""bl AS (SELECT a.id AS a, b.id AS b, a.x AS ax, b.x AS bx, a.s AS sa, b.s AS sb FROM nm a JOIN nm b ON a.id < b.id
  WHERE abs(length(a.x) - length(b.x)) / greatest(length(a.x), 1) <= 0.30::DOUBLE * 3
  AND (left(a.x, 3) = left(b.x, 3) OR a.x = '' OR b.x = '' OR ({_edit('left(a.x, 6)', 'left(b.x, 6)')}) > 0.7))"""
VOLUMES = f"""WITH {EV}, w AS (SELECT seq, src, t, count(*) OVER (PARTITION BY src ORDER BY t RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) AS volume FROM ev)
SELECT seq, volume, volume > 1.5 * greatest(1.0, coalesce(avg(volume) OVER (PARTITION BY src ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0)) AS is_spike FROM w"""
COMPOSITE = f"""least(1.0, 0.15 * ({_edit('ax', 'bx')}) + 0.08 * ({_prefix('ax', 'bx')}) + 0.12 * ({_edit('sa', 'sb')})
  + 0.15 + 0.15 + 0.12 + 0.13 + 0.10)"""
#: Leader clustering: entities in order of id, each with the list of leaders so far.
RESOLVED = f"""WITH RECURSIVE {NAMES}, {BLOCKS}, sc AS (SELECT a, b FROM bl WHERE ({COMPOSITE})::DOUBLE >= 0.951),
bf AS (SELECT b, list_sort(list(a)) AS before FROM sc GROUP BY b),
od AS (SELECT id, row_number() OVER (ORDER BY id) AS i, coalesce(before, []) AS before FROM nm LEFT JOIN bf ON b = id),
rs(i, id, survivor, leaders) AS (SELECT i, id, id, [id] FROM od WHERE i = 1 UNION ALL
  SELECT i, id, coalesce(lead, id), CASE WHEN lead IS NULL THEN list_append(leaders, id) ELSE leaders END
  FROM (SELECT od.i, od.id, rs.leaders, list_filter(od.before, lambda x: list_contains(rs.leaders, x))[1] AS lead FROM rs JOIN od ON od.i = rs.i + 1))"""
#: The record of a rejected event, as it is kept.
PAYLOAD = """{'seq': seq, 'id_source': seq, 'type_evenement': type_evenement, 'type_source': type_source,
  'horodatage': strftime(horodatage, '%Y-%m-%dT%H:%M:%S.%gZ'), 'montant': montant, 'id_entite_source': src, 'id_entite_cible': dst,
  'score_corroboration': corroboration, 'nombre_sources': sources, 'saut_hierarchique': jump}"""
LABELS = "lb AS (SELECT user_id AS id, CASE WHEN max(value) > 250 THEN 'FRAUDE' ELSE 'FAUX_POSITIF' END AS label FROM events GROUP BY 1)"


def _pick(values: tuple[str, ...], u: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"[{listed}][floor({u} * {len(values)})::BIGINT + 1]"


def _whole(u: str, low: int, high: int) -> str:
    return f"(floor({u} * {high - low + 1})::BIGINT + {low})"


def _generated(n: int = 1000, seed: int = 42, rings: int = 5) -> str:
    """CTE en: the generator's entities, from their definition."""

    def u(name: str) -> str:
        return _uniform(seed, name, "id")

    ip = " || '.' || ".join([f"CASE WHEN odd THEN {_whole(u('ip0'), 193, 223)} ELSE {_whole(u('ip0'), 10, 192)} END", *(_whole(u(f"ip{i}"), 1, 254) for i in (1, 2, 3))])
    return f"""ea AS (SELECT range AS id, CASE WHEN range < {n // 10} THEN (range % {rings})::INT END AS id_reseau, range < {n // 10 + n * 15 // 100} AS odd,
  CASE WHEN range < {n // 10} THEN 'FRAUDE' WHEN range < {n // 10 + n * 15 // 100} THEN 'SUSPECT' ELSE 'NORMAL' END AS categorie FROM range({n})),
eb AS (SELECT *, {_pick(generator.KINDS, u('kind'))} AS type_entite, {_pick(generator.FIRST_NAMES, u('first'))} AS prenom,
  {_pick(generator.LAST_NAMES, u('last'))} AS nom_famille, {_pick(generator.CITIES, u('city'))} AS ville FROM ea),
en AS (SELECT id, odd, 'ENT-' || lpad(id::VARCHAR, 8, '0') AS identifiant, prenom || ' ' || nom_famille AS nom, prenom, nom_famille,
  translate(lower(prenom || '.' || nom_famille), 'éèêëîïôöûüàâç', 'eeeeiioouuaac') || {_whole(u('box'), 1, 99)} || '@' || {_pick(generator.MAIL_DOMAINS, u('mail'))} AS email,
  '+33' || {_pick(('6', '7'), u('mobile'))} || lpad({_whole(u('phone'), 0, 10**8 - 1)}::VARCHAR, 8, '0') AS telephone,
  CASE WHEN id_reseau IS NOT NULL THEN (id_reseau + 1) || ' quai du Réseau' ELSE {_whole(u('house'), 1, 200)} || ' ' || {_pick(generator.STREETS, u('street'))} || ' ' || ville END AS adresse,
  CASE WHEN id_reseau IS NOT NULL THEN '203.0.113.' || (id_reseau + 1) ELSE {ip} END AS adresse_ip,
  'CPT-' || lpad({_whole(u('account'), 0, 10**10 - 1)}::VARCHAR, 10, '0') AS numero_compte,
  CASE WHEN type_entite = 'ENTREPRISE' THEN lpad({_whole(u('siret'), 0, 10**14 - 1)}::VARCHAR, 14, '0') END AS siret,
  type_entite, {_pick(generator.SEGMENTS, u('segment'))} AS segment, categorie, id_reseau,
  round(CASE WHEN odd THEN 0.6::DOUBLE + {u('risk')} * 0.35::DOUBLE ELSE {u('risk')} * 0.35::DOUBLE END, 6) AS score_risque,
  epoch(TIMESTAMP '2024-07-01')::BIGINT - 86400 * {_whole(u('age'), 0, 1095)} AS date_creation, ville,
  round(CASE WHEN odd THEN 8000 + {u('mean')} * 192000 ELSE 10 + {u('mean')} * 4990 END, 6) AS montant_moyen,
  round(CASE WHEN odd THEN 100 + {u('std')} * 4900 ELSE 10 + {u('std')} * 490 END, 6) AS montant_ecart_type,
  CASE WHEN odd THEN {_whole(u('communities'), 1, 3)} ELSE 1 END::INT AS nb_communautes, false AS est_hub,
  categorie = 'FRAUDE' AND {u('synthetic')} < 0.4::DOUBLE AS identite_synthetique, 0.0::DOUBLE AS score_pagerank,
  CASE WHEN odd AND {u('label')} < 0.6::DOUBLE THEN 'FRAUDE' END AS label_verite, {_pick(generator.MODELS, u('model'))} AS segment_modele FROM eb)"""


def _generated_events(n: int = 1000, seed: int = 42, rings: int = 5) -> str:
    def u(name: str) -> str:
        return _uniform(seed, name, "identifiant", "k", "ring")

    def kind(shares: tuple[int, ...]) -> str:
        steps = [sum(shares[: i + 1]) / 100 for i in range(len(shares))]
        return "CASE " + " ".join(f"WHEN {u('kind')} < {t}::DOUBLE THEN '{k}'" for k, t in zip(generator.EVENT_KINDS, steps, strict=True)) + " END"

    one = _uniform(seed, "n", "identifiant")
    raw = f"CASE WHEN odd THEN 8000 + {u('amount')} * 192000 ELSE 10 + {u('amount')} * 4990 END"
    return f"""WITH {_generated(n, seed, rings)}, ez AS (SELECT id_reseau, count(*) AS size FROM en WHERE id_reseau IS NOT NULL GROUP BY 1),
es AS (SELECT en.*, size FROM en LEFT JOIN ez USING (id_reseau)),
ek AS (SELECT es.*, unnest(generate_series(1, CASE WHEN odd THEN {_whole(one, 1, 24)} ELSE {_whole(one, 1, 8)} END)) AS k, false AS ring FROM es
  UNION ALL SELECT es.*, unnest(generate_series(1, least(size - 1, 3))) AS k, true AS ring FROM es WHERE size > 1),
ev AS (SELECT *, {raw} AS raw, CASE WHEN ring
  THEN ((floor(id / {rings})::BIGINT + 1 + (floor({_uniform(seed, 'ring', 'identifiant')} * (size - 1))::BIGINT + k) % (size - 1)) % size) * {rings} + id_reseau
  ELSE (id + 1 + floor({u('other')} * {n - 1})::BIGINT) % {n} END AS other FROM ek)
SELECT 'EVT-' || identifiant || '-' || CASE WHEN ring THEN 'R' ELSE '' END || k AS id_source,
  CASE WHEN ring THEN 'TRANSACTION' WHEN odd THEN {kind(generator.ODD_SHARES)} ELSE {kind(generator.NORMAL_SHARES)} END AS type_evenement,
  CASE WHEN ring THEN 'INTERNE' ELSE {_pick(('INTERNE', 'EXTERNE'), u('source'))} END AS type_source,
  epoch(TIMESTAMP '2024-07-01')::BIGINT - 86400 * CASE WHEN ring THEN {_whole(u('day'), 0, 29)} ELSE {_whole(u('day'), 0, 28)} END - 3600 * {_whole(u('hour'), 0, 23)} AS horodatage,
  CASE WHEN odd AND {u('round')} < 0.3::DOUBLE THEN round(raw / 1000) * 1000 ELSE round(raw, 2) END AS montant,
  identifiant AS id_entite_source, 'ENT-' || lpad(other::VARCHAR, 8, '0') AS id_entite_cible,
  round(CASE WHEN ring THEN 0.1::DOUBLE + {u('corroboration')} * 0.4::DOUBLE WHEN odd THEN 0.1::DOUBLE + {u('corroboration')} * 0.6::DOUBLE
    ELSE 0.3::DOUBLE + {u('corroboration')} * 0.7::DOUBLE END, 3) AS score_corroboration,
  CASE WHEN ring THEN 1 ELSE {_whole(u('sources'), 1, 3)} END AS nombre_sources, CASE WHEN ring THEN 0 ELSE {_whole(u('jump'), 0, 2)} END AS saut_hierarchique, adresse_ip FROM ev"""


def _generated_edges(n: int = 1000, seed: int = 42, rings: int = 5) -> str:
    def u(name: str) -> str:
        return _uniform(seed, name, "src", "dst", "type")

    def sharing(attribute: str, kind: str) -> str:
        return f"SELECT a.identifiant AS src, b.identifiant AS dst, '{kind}' AS type FROM en a JOIN en b ON a.{attribute} = b.{attribute} AND a.identifiant < b.identifiant"

    links = _uniform(seed, "links", "identifiant")
    return f"""WITH {_generated(n, seed, rings)},
cl AS (SELECT identifiant AS src, unnest(generate_series(1, CASE WHEN odd THEN {_whole(links, 1, 5)} ELSE {_whole(links, 1, 3)} END)) AS k FROM en),
ct AS (SELECT DISTINCT src, 'ENT-' || lpad({_whole(_uniform(seed, 'target', 'src', 'k'), 0, n - 1)}::VARCHAR, 8, '0') AS dst, 'CAUSE_DE' AS type FROM cl),
al AS ({sharing('adresse_ip', 'PARTAGE_IP')} UNION ALL {sharing('adresse', 'PARTAGE_ADRESSE')} UNION ALL {sharing('id_reseau', 'COSIGNATURE')}
  UNION ALL SELECT * FROM ct WHERE src <> dst)
SELECT src, dst, type, round(CASE type WHEN 'PARTAGE_IP' THEN 0.4::DOUBLE + {u('confidence')} * (0.9::DOUBLE - 0.4::DOUBLE) WHEN 'PARTAGE_ADRESSE' THEN 0.3::DOUBLE + {u('confidence')} * (0.7::DOUBLE - 0.3::DOUBLE)
    WHEN 'CAUSE_DE' THEN 0.1::DOUBLE + {u('confidence')} * (0.9::DOUBLE - 0.1::DOUBLE) ELSE 0.1::DOUBLE + {u('confidence')} * (0.4::DOUBLE - 0.1::DOUBLE) END, 3) AS score_confiance,
  epoch(TIMESTAMP '2024-07-01')::BIGINT - 86400 * {_whole(u('age'), 0, 1095)} AS date_creation,
  type = 'CAUSE_DE' AND {u('inactive')} < 0.05::DOUBLE AS inactif, CASE WHEN type = 'CAUSE_DE' THEN {_whole(u('delta'), 60, 72 * 3600)}::DOUBLE END AS delta_secondes FROM al"""


def _metrics() -> str:
    return """round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1, round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 4) AS accuracy,
  round(coalesce(tn / nullif(tn + fp, 0), 0), 4) AS specificity,
  round(coalesce((tp * tn - fp * fn) / nullif(sqrt(((tp + fp) * (tp + fn))::DOUBLE * ((tn + fp) * (tn + fn))::DOUBLE), 0), 0), 4) AS mcc"""


FEATURE_SQL = f"""WITH {_chain('2024-02-15', False)}, {E}, {P}, {_rank(10)}, {CONFIDENCE}, {VERT}, {HUBS}, {GROUPS}, {COHESION},
fo AS (SELECT src AS id, count(*) AS degre_sortant, avg(coalesce(score_confiance, 0)) AS confiance_moy,
  count(*) FILTER (last_seen < TIMESTAMP '2024-02-15' - INTERVAL 30 DAY) / count(*) AS ratio FROM conf GROUP BY 1),
fi AS (SELECT dst AS id, count(*) AS degre_entrant FROM conf GROUP BY 1),
fh AS (SELECT nd.src AS id, count(*) AS nb_hubs FROM nd JOIN hub ON hub.id = nd.dst AND est_hub GROUP BY 1),
fa AS (SELECT src AS id, avg(montant) AS mm, stddev_pop(montant) AS ms, sum(len(flags)) AS nf, min(horodatage) AS fs, avg(corroboration) AS co FROM v GROUP BY 1),
fc AS (SELECT id_communaute, avg(coalesce(rank, 0)) AS pc FROM cp LEFT JOIN r10 USING (id) GROUP BY 1),
ft AS (SELECT vt.id, round(coalesce(rank, 0)::DOUBLE + 1e-10, 6) AS pagerank, coalesce(degre_entrant, 0)::DOUBLE AS degre_entrant,
  coalesce(degre_sortant, 0)::DOUBLE AS degre_sortant, round(coalesce(confiance_moy, 0)::DOUBLE + 1e-10, 6) AS confiance_moy,
  round(coalesce(cohesion, 0)::DOUBLE + 1e-10, 6) AS cohesion, 0.0::DOUBLE AS synthetique, coalesce(nf, 0)::DOUBLE AS nb_flags,
  round(coalesce(mm, 0)::DOUBLE + 1e-10, 6) AS montant_moyen, round(coalesce(ms, 0)::DOUBLE + 1e-10, 6) AS montant_std, 1.0::DOUBLE AS nb_communautes,
  coalesce(floor((epoch(TIMESTAMP '2024-02-15') - floor(epoch(fs))) / 86400), 0)::DOUBLE AS anciennete, 0.0::DOUBLE AS nb_fusions,
  round(coalesce(pc, 0)::DOUBLE + 1e-10, 6) AS pagerank_com, round(coalesce(ratio, 0)::DOUBLE + 1e-10, 6) AS ratio_inactifs,
  coalesce(nb_hubs, 0)::DOUBLE AS nb_hubs, round(coalesce(co, 0.5)::DOUBLE + 1e-10, 6) AS corroboration
  FROM vt LEFT JOIN r10 USING (id) LEFT JOIN fo USING (id) LEFT JOIN fi USING (id) LEFT JOIN cp USING (id) LEFT JOIN coh USING (id_communaute)
  LEFT JOIN fc USING (id_communaute) LEFT JOIN fh USING (id) LEFT JOIN fa USING (id))"""


def statements() -> dict[str, str]:
    flags = "SELECT seq, motif, array_to_string(flags, ',') AS flags FROM v"
    causal = f"""WITH {EV}, c AS (SELECT a.seq AS cause, b.seq AS effect, a.type_evenement AS cause_type, b.type_evenement AS effect_type,
  (b.t - a.t) / 1000000.0::DOUBLE AS delta FROM ev a JOIN ev b ON (a.src = b.src OR a.dst = b.src)
  AND (b.t > a.t OR (b.t = a.t AND b.seq > a.seq)) AND b.t - a.t <= 72 * 3600000000
  WHERE (a.type_evenement, b.type_evenement) IN (('EMAIL','TRANSACTION'),('TRANSACTION','TRANSACTION'),('LOG_ACCES','TRANSACTION'),('EMAIL','APPROBATION')))"""
    return {
        "validate_events": f"WITH {_chain('2024-07-10', True)} {flags}",
        "validate_rules": f"WITH {_chain('2024-02-15', False)} {flags}",
        "reject_counts": f"WITH {_chain('2024-07-10', False)} SELECT trim(split_part(motif, ':', 1)) AS motif, count(*) AS n FROM v WHERE motif IS NOT NULL GROUP BY 1",
        "reject_sink": f"WITH {_chain('2024-07-10', False)} SELECT seq::VARCHAR AS identifiant_source, type_evenement, motif AS motif_rejet, left(to_json({PAYLOAD}), 500) AS donnees_brutes FROM v WHERE motif IS NOT NULL",
        "dedup_events": f"""WITH RECURSIVE {EV}, nx AS (SELECT a.seq, a.src, a.type_evenement, a.t, min(b.t) AS nt FROM ev a LEFT JOIN ev b
  ON a.src = b.src AND a.type_evenement = b.type_evenement AND b.t >= a.t + 3600000000 GROUP BY 1, 2, 3, 4),
k(src, type_evenement, t) AS (SELECT src, type_evenement, min(t) FROM ev GROUP BY 1, 2 UNION
  SELECT nx.src, nx.type_evenement, nx.nt FROM k JOIN nx ON k.src = nx.src AND k.type_evenement = nx.type_evenement AND k.t = nx.t WHERE nx.nt IS NOT NULL)
SELECT seq, k.t IS NULL AS is_duplicate FROM ev LEFT JOIN k USING (src, type_evenement, t)""",
        "volume_spike": VOLUMES,
        "amount_outlier": f"""WITH {EV}, h AS (SELECT seq, montant, list_sort(coalesce(list(montant) OVER (ORDER BY seq ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING), [])) AS past
  FROM ev WHERE type_evenement = 'TRANSACTION' AND montant IS NOT NULL)
SELECT seq, len(past) AS history, coalesce(len(past) >= 10 AND past[len(past) // 2 + 1] > 0 AND montant > 5.0 * past[len(past) // 2 + 1], false) AS is_outlier FROM h""",
        "causal_links": f"{causal} SELECT cause, effect, cause_type, effect_type, round(delta, 3) AS delta_secondes FROM c",
        "causal_link_counts": f"{causal} SELECT cause_type, effect_type, count(*) AS n, round(avg(delta), 3) AS mean_delta FROM c GROUP BY 1, 2",
        "inactive_links": "SELECT o_custkey AS src, o_orderkey AS dst, o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 365 DAY AS inactif FROM orders",
        "shared_attribute_pairs": """SELECT a.c_custkey AS src, b.c_custkey AS dst, g.n AS group_size FROM customer a JOIN customer b
  ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey
  JOIN (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) g ON g.c_nationkey = a.c_nationkey AND g.c_mktsegment = a.c_mktsegment""",
        "synthetic_identity": """WITH c AS (SELECT c_custkey AS id, CAST(round(c_acctbal, 0) AS BIGINT) AS bal, c_mktsegment || c_nationkey AS place FROM customer)
SELECT a.id, count(*) AS n_recent FROM c a JOIN c b ON a.id <> b.id AND (a.bal = b.bal OR a.place = b.place) GROUP BY 1 HAVING count(*) >= 3""",
        "two_hop_paths": f"WITH {P}, {PATHS} SELECT src, dst, count(*) AS n_paths FROM pp GROUP BY 1, 2",
        "degree_hubs": f"WITH {E}, {_both('nb', 'e')}, {VERT}, {HUBS} SELECT id, degre, round(threshold, 6) AS threshold, est_hub FROM hub",
        "pagerank_k": f"WITH {P}, {_rank(10)} SELECT id, round(rank, 6) AS rank FROM r10",
        "cliques": f"""WITH c AS (SELECT c_custkey AS id, c_nationkey AS n, c_mktsegment AS m, floor(c_acctbal / 1000) AS b FROM customer),
e AS (SELECT x.id AS src, y.id AS dst FROM c x JOIN c y ON x.n = y.n AND x.m = y.m AND x.b = y.b AND x.id < y.id), {_both('nb', 'e')}, s0 AS (SELECT DISTINCT src, dst FROM nb), big AS (SELECT src FROM s0 GROUP BY 1 HAVING count(*) >= 2),
s AS (SELECT * FROM s0 WHERE src IN (SELECT src FROM big) AND dst IN (SELECT src FROM big)),
d AS (SELECT src AS v, count(*) AS d, list_sort(list(dst) || [src]) AS m FROM s GROUP BY src HAVING count(*) >= 2),
t AS (SELECT a.src AS v, count(*) AS tri FROM s a JOIN s x ON x.src = a.dst AND x.src < x.dst JOIN s b ON b.src = a.src AND b.dst = x.dst GROUP BY 1)
SELECT DISTINCT len(m) AS size, array_to_string(m, ',') AS members FROM d JOIN t USING (v) WHERE tri * 2 = d * (d - 1)""",
        "closeness_bounded": f"""WITH RECURSIVE {P}, {_both('nb', 'p')}, s AS (SELECT DISTINCT src, dst FROM nb),
r(o, a, d) AS (SELECT src, dst, 1 FROM s UNION SELECT r.o, s.dst, r.d + 1 FROM r JOIN s ON r.a = s.src WHERE r.d < 3)
SELECT o AS id, count(*) AS reach, round(count(*) / sum(d), 6) AS closeness FROM (SELECT o, a, min(d) AS d FROM r WHERE o <> a GROUP BY 1, 2) GROUP BY 1""",
        "neighbor_jaccard": f"WITH {E}, {JACCARD} SELECT src, dst, round(jaccard, 6) AS jaccard FROM jac",
        "link_confidence": f"WITH {EV}, {E}, {CONFIDENCE} SELECT src, dst, score_confiance FROM conf",
        "components": f"WITH RECURSIVE {P}, {_components('cp', 'p')} SELECT id, id_communaute AS component FROM cp",
        "cohesion": f"WITH {P}, {GROUPS}, {COHESION} SELECT id_communaute, size, cohesion, {CLASS} AS classe FROM coh",
        "core_members": f"WITH {P}, {GROUPS}, {CREATED}, {_core(0.2)} SELECT * FROM core",
        "community_evolution": f"WITH {P}, {GROUPS}, {BEFORE}, {EVOLUTION} SELECT * FROM evo",
        "modularity": f"""WITH {P}, {GROUPS}, {_both('nb', 'p')}, m AS (SELECT count(*)::DOUBLE AS m FROM p),
i AS (SELECT count(*)::DOUBLE AS inside FROM p JOIN cp a ON a.id = p.src JOIN cp b ON b.id = p.dst WHERE a.id_communaute = b.id_communaute),
k AS (SELECT sum(k * k) AS k2 FROM (SELECT id_communaute, count(*)::DOUBLE AS k FROM nb JOIN cp ON cp.id = nb.src GROUP BY 1))
SELECT round(inside / m - k2 / (4 * m * m), 6) AS modularity FROM m, i, k""",
        "community_summary": f"""WITH {P}, {GROUPS}, {BEFORE}, {EVOLUTION}, {COHESION}, {CREATED}, {_core(0.70)}
SELECT id_communaute, coh.size, round(cohesion, 4) AS cohesion, {CLASS} AS classe, coalesce(k, 0) AS core_size, evolution
FROM coh JOIN evo USING (id_communaute) LEFT JOIN (SELECT id_communaute, count(*) AS k FROM core GROUP BY 1) USING (id_communaute)""",
        "name_similarity": f"""WITH {TURNS} SELECT a.conv_id, a.turn, round(({_edit('a.x', 'b.x')})::DOUBLE, 6) AS nom, ({_prefix('a.x', 'b.x')})::DOUBLE AS phonetique,
  (a.s = b.s)::INT::DOUBLE AS role FROM nm a JOIN nm b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn""",
        "block_candidates": f"WITH {NAMES}, {BLOCKS} SELECT a, b FROM bl",
        "composite_similarity": f"WITH {NAMES}, {BLOCKS}, sc AS (SELECT a, b, ({COMPOSITE})::DOUBLE AS s FROM bl) SELECT a, b, round(s, 6) AS similarite FROM sc WHERE s >= 0.951",
        "risk_features": f"{FEATURE_SQL} SELECT * REPLACE (round(montant_moyen, 3) AS montant_moyen, round(montant_std, 3) AS montant_std) FROM ft",
        "neighbor_risk": f"WITH {EV}, {E}, {CONFIDENCE}, {VERT}, {RISK}, {GNN} SELECT * FROM gnn",
        "risk_decision": f"""{FEATURE_SQL}, {RISK}, {GNN}, hx AS (SELECT max(nb_flags) AS mf, max(montant_moyen) AS mm FROM ft),
sc AS (SELECT ft.id, round(0.40 * round(least(1, (synthetique + coalesce(nb_flags / nullif(mf, 0), 0) + coalesce(montant_moyen / nullif(mm, 0), 0)) / 3), 6)
  + 0.60 * score_gnn, 6) AS score_risque FROM ft CROSS JOIN hx JOIN gnn USING (id))
SELECT id, score_risque, CASE WHEN score_risque >= 0.3 THEN 'FRAUDE_SUSPECTEE' ELSE 'NORMAL' END AS decision_fraude,
  CASE WHEN score_risque >= 200.0 / (200.0 + 50000.0) THEN 'FRAUDE_SUSPECTEE' ELSE 'NORMAL' END AS decision_cout FROM sc""",
        "confusion_metrics": f"""WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic <> 1 AND quality = 0) AS fp,
  count(*) FILTER (toxic = 1 AND quality <> 0) AS fn, count(*) FILTER (toxic <> 1 AND quality <> 0) AS tn FROM labels) SELECT *, {_metrics()} FROM c""",
        "bias_report": """WITH r AS (SELECT lang AS segment, count(*) AS total, count(*) FILTER (toxic = 1) AS detected,
  round(count(*) FILTER (toxic = 1) / count(*), 6) AS taux_detection FROM labels JOIN documents USING (doc_id) GROUP BY 1),
x AS (SELECT max(taux_detection) AS hi, min(taux_detection) AS lo, count(*) AS n FROM r)
SELECT r.*, n >= 2 AND (lo = 0 OR hi / lo > 1.5) AS biais FROM r, x""",
        "retrain_trigger": """SELECT count(*) FILTER (toxic IS NOT NULL AND coalesce(quality, 1) <> 0) AS nouveaux_labels,
  count(*) FILTER (toxic IS NOT NULL AND coalesce(quality, 1) <> 0) >= 50 AS reentrainer FROM labels""",
        "feedback_neighbors": f"""WITH {E}, {_both('nb', 'e')}, {VERT}, {RISK}, {LABELS},
dl AS (SELECT nb.dst AS id, sum(CASE WHEN label = 'FRAUDE' THEN 0.10 ELSE -0.15 END)::DOUBLE AS delta FROM nb JOIN lb ON lb.id = nb.src GROUP BY 1)
SELECT id, round(least(1, greatest(0, coalesce(risk, 0.1) + delta)), 6) AS score_risque FROM rv JOIN dl USING (id)""",
        "feedback_community": f"""WITH {E}, {P}, {VERT}, {RISK}, {LABELS}, {GROUPS}, {COHESION},
st AS (SELECT lb.id, cp.id_communaute, (CASE WHEN label = 'FRAUDE' THEN 0.05 ELSE -0.075 END)::DOUBLE AS step
  FROM lb JOIN cp USING (id) JOIN coh USING (id_communaute) WHERE cohesion >= 0.3),
dl AS (SELECT cp.id, sum(st.step) AS delta FROM cp JOIN st ON st.id_communaute = cp.id_communaute AND st.id <> cp.id GROUP BY 1)
SELECT rv.id, round(least(1, greatest(0, coalesce(risk, 0.1) + round(delta, 9))), 6) AS score_risque FROM rv JOIN dl USING (id)""",
        "entity_scan": "SELECT c_custkey, c_name, c_mktsegment FROM customer",
        "entity_upsert": """WITH n AS (SELECT DISTINCT o_custkey * 2 AS k FROM orders)
SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN k IS NOT NULL THEN 'ACTIVE' ELSE c_mktsegment END AS c_mktsegment FROM customer FULL JOIN n ON k = c_custkey""",
        "edge_insert": f"""WITH {EV}, n AS (SELECT DISTINCT src, dst, horodatage < TIMESTAMP '2024-01-10' AS old FROM ev
  WHERE type_evenement = 'TRANSACTION' AND src <> dst), u AS (SELECT DISTINCT src AS id FROM ev)
SELECT DISTINCT src, dst, 'CAUSE_DE' AS type FROM n WHERE old OR (src IN (SELECT id FROM u) AND dst IN (SELECT id FROM u))""",
        "event_upsert": f"""WITH {_chain('2024-02-15', False)} SELECT seq AS id_source, type_evenement, montant, array_to_string(flags, ',') AS flags,
  CASE WHEN horodatage < TIMESTAMP '2024-01-10' THEN 946684800 ELSE 1707955200 END AS created,
  CASE WHEN horodatage < TIMESTAMP '2024-01-10' THEN 1707955200 END AS updated FROM v""",
        "normalized_identifiers": "SELECT c_custkey, lower(trim(c_name)) AS identifiant FROM customer",
        "class_tally": """WITH w AS (SELECT unnest(['NORMAL', 'SUSPECT', 'FRAUDE', 'INCONNU']) AS classe),
t AS (SELECT CASE WHEN toxic = 1 THEN 'FRAUDE' WHEN quality = 0 THEN 'SUSPECT' ELSE 'NORMAL' END AS classe FROM labels)
SELECT w.classe, count(t.classe) AS n FROM w LEFT JOIN t USING (classe) GROUP BY 1""",
        "held_out_metrics": f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY md5('0|' || doc_id), doc_id) - 1 AS place, count(*) OVER () AS n FROM labels),
h AS (SELECT * FROM r WHERE place >= floor(n * 0.7::DOUBLE)),
c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic <> 1 AND quality = 0) AS fp,
  count(*) FILTER (toxic = 1 AND quality <> 0) AS fn, count(*) FILTER (toxic <> 1 AND quality <> 0) AS tn FROM h) SELECT *, {_metrics()} FROM c""",
        "null_model": f"""WITH x AS (SELECT 0.25 * least(1, ln(1 + floor({_uniform(0, 'n', 'range')} * 100) + 1) / ln(101))
  + 0.20 * exp(-0.005 * floor({_uniform(0, 'days', 'range')} * 365)) + 0.20 * (floor({_uniform(0, 'kinds', 'range')} * 5) + 1) / 5
  + 0.15 * {_uniform(0, 'corroboration', 'range')} AS x FROM range(1000)),
m AS (SELECT avg(x) AS mean, greatest(stddev_pop(x), 1e-9) AS std FROM x),
k AS (SELECT mean, std, avg(power(x - mean, 3)) / power(std, 3) AS skewness FROM x, m GROUP BY mean, std)
SELECT round(mean, 6) AS mean, round(std, 6) AS std, round(skewness, 6) AS skewness, round((0.9 - mean) / std, 6) AS z,
  (0.9 - mean) / std > 2.0 AS significant, abs(skewness) > 0.5 AS skewed FROM k""",
        "pagerank_converged": f"""WITH RECURSIVE {P}, {PATHS}, pm AS (SELECT src, dst, count(*) AS mult FROM pp GROUP BY 1, 2),
po AS (SELECT src, sum(mult)::DOUBLE AS o FROM pm GROUP BY 1), pl AS (SELECT src, dst, o FROM pm JOIN po USING (src)),
pn AS (SELECT src AS id FROM pl UNION SELECT dst FROM pl), pc AS (SELECT count(*)::DOUBLE AS n FROM pn),
r(i, id, rank) AS (SELECT 0, id, 1.0::DOUBLE / n FROM pn, pc UNION ALL
  SELECT g.i + 1, pn.id, 0.15::DOUBLE / n + 0.85 * coalesce(s.got, 0) FROM pn CROSS JOIN pc CROSS JOIN (SELECT min(i) AS i FROM r) g
  LEFT JOIN (SELECT dst, sum(rank / o) AS got FROM pl JOIN r ON src = r.id GROUP BY 1) s ON s.dst = pn.id WHERE g.i < 100),
d AS (SELECT a.i, max(abs(a.rank - b.rank)) AS moved FROM r a JOIN r b ON b.id = a.id AND b.i = a.i - 1 WHERE a.i % 5 = 0 GROUP BY 1),
l AS (SELECT coalesce(min(i) FILTER (moved < 1e-6), 100) AS i FROM d)
SELECT id, round(rank, 6) AS rank FROM r JOIN l USING (i)""",
        "resolve_entities": f"{RESOLVED} SELECT id AS merged, survivor FROM rs WHERE id <> survivor",
        "merge_entities": f"""{RESOLVED}, mv AS (SELECT x.survivor AS src, y.survivor AS dst FROM sc JOIN rs x ON x.id = sc.a JOIN rs y ON y.id = sc.b)
SELECT count(*) FILTER (id = survivor) AS entities, count(DISTINCT survivor) FILTER (id <> survivor) AS survivors,
  (SELECT count(*) FROM mv WHERE src <> dst) AS edges FROM rs""",
        "scalar_functions": """SELECT c_custkey, sha256(c_name) AS empreinte,
  round(CASE WHEN c_custkey <= 1 THEN 0 ELSE 2.0 * (ln(c_custkey - 1) + 0.5772156649015329::DOUBLE) - 2.0 * (c_custkey - 1) / c_custkey END::DOUBLE, 6) AS profondeur,
  round(least(1.0, greatest(0.0, c_acctbal / 5000.0))::DOUBLE, 6) AS borne, round(least(1.0, ln(1 + c_custkey) / ln(101))::DOUBLE, 6) AS frequence,
  round(exp(-0.005::DOUBLE * c_custkey), 6) AS recence,
  epoch(TIMESTAMP '2024-01-01 06:00:00')::BIGINT + (c_custkey % 28) * 86400 - CASE WHEN c_custkey % 2 = 0 THEN 7200 ELSE 0 END AS utc FROM customer""",
        "shuffled_entities": "SELECT c_custkey, row_number() OVER (ORDER BY md5('7|' || c_custkey), c_custkey) - 1 AS position FROM customer",
        "dense_numbers": "SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS numero FROM (SELECT DISTINCT p_brand FROM part)",
        "recorded_labels": f"""WITH {E}, {VERT}, {RISK}, {LABELS} SELECT rv.id, CASE WHEN label = 'FRAUDE' THEN 'FRAUDE' WHEN risk > 0.5 THEN 'NORMAL' END AS label_verite
FROM rv LEFT JOIN lb USING (id)""",
        "written_back": """SELECT c_custkey, c_mktsegment, n AS n_orders, m AS last_order FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
        "deleted_vertices": f"""WITH {E}, {VERT}, {LABELS}, gone AS (SELECT id FROM lb WHERE label = 'FRAUDE')
SELECT id AS src, NULL::BIGINT AS dst FROM vt WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT src, dst FROM e WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)""",
        "versioned_tables": f"""WITH {E}, {VERT} SELECT 1 AS version, 'edges' AS name, count(*) AS n FROM e UNION ALL SELECT 1, 'vertices', count(*) FROM vt
UNION ALL SELECT 2, 'edges', count(*) FROM e WHERE src < dst""",
        "generated_entities": f"WITH {_generated()} SELECT * EXCLUDE (id, odd) FROM en",
        "generated_events": _generated_events(),
        "generated_edges": _generated_edges(),
        "stream_dedup": f"WITH {EV} SELECT DISTINCT src AS id_entite_source, type_evenement FROM ev",
        "stream_rules": f"WITH {_chain('2024-02-15', False)} {flags}",
        "stream_causal_links": f"{causal} SELECT cause, effect, cause_type, effect_type FROM c",
        "stream_outliers": f"""WITH {EV}, h AS (SELECT seq, montant, list_sort(coalesce(list(montant) OVER (ORDER BY t, seq ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING), [])) AS past
  FROM ev WHERE type_evenement = 'TRANSACTION' AND montant IS NOT NULL)
SELECT seq, coalesce(len(past) >= 10 AND past[len(past) // 2 + 1] > 0 AND montant > 5.0 * past[len(past) // 2 + 1], false) AS is_outlier FROM h""",
        "stream_spikes": VOLUMES,
        "constraint_check": "SELECT o_custkey::VARCHAR AS key, 'unique' AS rule, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1 OR o_custkey IS NULL",
    }
