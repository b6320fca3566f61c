"""Synthetic entities, events and relationships as seeded column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.functions.scalar import uniform

#: Value lists of the generator (fixed values).
KINDS = ("PERSONNE", "ENTREPRISE", "COMPTE_BANCAIRE", "MARCHAND")
SEGMENTS = ("RETAIL", "CORPORATE", "PME", "PARTICULIER", "PROFESSIONNEL")
EVENT_KINDS = ("TRANSACTION", "EMAIL", "SMS", "LOG_ACCES", "APPROBATION")
#: Per cent of each kind among the events of normal and of other entities (fixed values).
NORMAL_SHARES, ODD_SHARES = (40, 20, 15, 15, 10), (55, 15, 10, 10, 10)
MODELS = ("A", "B", "C")
#: Names, streets and cities to draw from.
FIRST_NAMES = (
    "Adèle", "Agnès", "Basile", "Bérénice", "Cédric", "Célestine", "Denis", "Élodie", "Fabien", "Gaëlle", "Gérard", "Hélène",
    "Irène", "Jérôme", "Joëlle", "Kévin", "Loïc", "Maëva", "Noémie", "Odile", "Quentin", "Rémi", "Solène", "Zoé",
)
LAST_NAMES = (
    "Aubert", "Barbier", "Bénard", "Carpentier", "Collet", "Delaunay", "Deschamps", "Étienne", "Fabre", "Gaillard", "Hamon", "Jacquet",
    "Klein", "Lacroix", "Lemaître", "Marchand", "Noël", "Olivier", "Pelletier", "Quéré", "Renard", "Schmitt", "Tessier", "Vasseur",
)
STREETS = ("rue des Écoles", "avenue de la Gare", "place du Marché", "chemin des Prés", "boulevard Voltaire", "impasse du Moulin")
CITIES = ("Amiens", "Besançon", "Brest", "Caen", "Clermont-Ferrand", "Le Havre", "Limoges", "Metz", "Nancy", "Nîmes", "Orléans", "Perpignan", "Reims", "Rouen", "Tours")
MAIL_DOMAINS = ("courrier.example", "poste.example", "boite.example", "message.example")


def _unit(seed: int, name: str, *keys: str) -> Column:
    """A uniform number that depends on the seed, a name and the row's keys only."""
    return uniform(seed, name, *keys)


def _pick(values: tuple[str, ...], u: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.floor(u * len(values)) + 1).cast("int"))


def _whole(u: Column, low: int, high: int) -> Column:
    return (F.floor(u * (high - low + 1)) + low).cast("bigint")


def entities(
    spark: SparkSession, n: int = 1000, seed: int = 42, as_of: str = "2024-07-01",
    ring_share: float = 0.10, suspect_share: float = 0.15, rings: int = 5,
) -> DataFrame:
    """``n`` entities; the first ones form fraud rings that share address and IP, the next ones are suspects."""
    in_rings, suspects = int(n * ring_share), int(n * suspect_share)

    def u(name: str) -> Column:
        return _unit(seed, name, "id")

    ring = F.when(F.col("id") < in_rings, (F.col("id") % rings).cast("int"))
    kind = F.when(F.col("id") < in_rings, "FRAUDE").when(F.col("id") < in_rings + suspects, "SUSPECT").otherwise("NORMAL")
    odd, fraud = F.col("categorie") != "NORMAL", F.col("categorie") == "FRAUDE"
    own_ip = F.concat_ws(".", F.when(odd, _whole(u("ip0"), 193, 223)).otherwise(_whole(u("ip0"), 10, 192)), *(_whole(u(f"ip{i}"), 1, 254) for i in range(1, 4)))
    money = F.when(odd, 8000 + u("mean") * 192000).otherwise(10 + u("mean") * 4990)
    plain = F.translate(F.lower(F.concat_ws(".", "prenom", "nom_famille")), "éèêëîïôöûüàâç", "eeeeiioouuaac")
    own_address = F.concat_ws(" ", _whole(u("house"), 1, 200).cast("string"), _pick(STREETS, u("street")), F.col("ville"))
    return (
        spark.range(n).withColumn("id_reseau", ring).withColumn("categorie", kind).withColumn("type_entite", _pick(KINDS, u("kind")))
        .withColumns({"prenom": _pick(FIRST_NAMES, u("first")), "nom_famille": _pick(LAST_NAMES, u("last")), "ville": _pick(CITIES, u("city"))})
        .select(
            F.format_string("ENT-%08d", "id").alias("identifiant"), F.concat_ws(" ", "prenom", "nom_famille").alias("nom"), "prenom", "nom_famille",
            F.concat(plain, _whole(u("box"), 1, 99).cast("string"), F.lit("@"), _pick(MAIL_DOMAINS, u("mail"))).alias("email"),
            F.concat(F.lit("+33"), _pick(("6", "7"), u("mobile")), F.format_string("%08d", _whole(u("phone"), 0, 10**8 - 1))).alias("telephone"),
            F.when(F.col("id_reseau").isNotNull(), F.concat_ws(" ", (F.col("id_reseau") + 1).cast("string"), F.lit("quai du Réseau")))
            .otherwise(own_address).alias("adresse"),
            F.when(F.col("id_reseau").isNotNull(), F.format_string("203.0.113.%d", F.col("id_reseau") + 1)).otherwise(own_ip).alias("adresse_ip"),
            F.format_string("CPT-%010d", _whole(u("account"), 0, 10**10 - 1)).alias("numero_compte"),
            F.when(F.col("type_entite") == "ENTREPRISE", F.format_string("%014d", _whole(u("siret"), 0, 10**14 - 1))).alias("siret"),
            "type_entite", _pick(SEGMENTS, u("segment")).alias("segment"), "categorie", "id_reseau",
            F.when(odd, 0.6 + u("risk") * 0.35).otherwise(u("risk") * 0.35).alias("score_risque"),
            (F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(_whole(u("age"), 0, 1095).cast("int"))).alias("date_creation"),
            "ville", money.alias("montant_moyen"),
            F.when(odd, 100 + u("std") * 4900).otherwise(10 + u("std") * 490).alias("montant_ecart_type"),
            F.when(odd, _whole(u("communities"), 1, 3)).otherwise(1).cast("int").alias("nb_communautes"), F.lit(False).alias("est_hub"),
            (fraud & (u("synthetic") < 0.4)).alias("identite_synthetique"), F.lit(0.0).alias("score_pagerank"),
            F.when(odd & (u("label") < 0.6), "FRAUDE").alias("label_verite"), _pick(MODELS, u("model")).alias("segment_modele"),
        )
    )


def _event_kind(odd: Column, u: Column) -> Column:
    """An event kind by the shares of its entity's class."""

    def of(shares: tuple[int, ...]) -> Column:
        out, total = None, 0
        for kind, share in zip(EVENT_KINDS, shares, strict=True):
            total += share
            test = u < total / 100
            out = F.when(test, kind) if out is None else out.when(test, kind)
        return out

    return F.when(odd, of(ODD_SHARES)).otherwise(of(NORMAL_SHARES))


def events(ents: DataFrame, seed: int = 42, as_of: str = "2024-07-01", low: int = 1, high: int = 8, within_ring: int = 3) -> DataFrame:
    """Events of each entity towards others: one to eight, three times as many at most for those that aren't normal,
    and up to three more of each ring member towards other members.

    Targets are computed, not joined: any entity by its number, and in a ring the members that follow.
    """
    n, rings = ents.agg(F.count("*"), F.count_distinct("id_reseau")).first()

    def u(name: str) -> Column:
        return _unit(seed, name, "identifiant", "k", "_ring")

    odd = F.col("categorie") != "NORMAL"
    number = F.substring("identifiant", 5, 8).cast("bigint")
    drawn = F.when(odd, _whole(_unit(seed, "n", "identifiant"), low, 3 * high)).otherwise(_whole(_unit(seed, "n", "identifiant"), low, high))
    size = ents.where(F.col("id_reseau").isNotNull()).groupBy("id_reseau").agg(F.count("*").alias("_size"))  # a row per ring
    sized = ents.join(F.broadcast(size), "id_reseau", "left")
    own = sized.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), drawn))).withColumn("_ring", F.lit(False))
    ring = sized.where(F.col("_size") > 1).withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.col("_size") - 1, F.lit(within_ring)))))
    many = own.unionByName(ring.withColumn("_ring", F.lit(True)))
    inside = F.col("_ring")
    place = F.floor(number / max(1, rings))
    start = F.floor(_unit(seed, "ring", "identifiant") * (F.col("_size") - 1))
    member = ((place + 1 + (start + F.col("k")) % (F.col("_size") - 1)) % F.col("_size")) * max(1, rings) + F.col("id_reseau")
    other = F.when(inside, member).otherwise((number + 1 + F.floor(u("other") * max(1, n - 1))) % n)
    amount = F.when(odd, 8000 + u("amount") * 192000).otherwise(10 + u("amount") * 4990)
    amount = F.when(odd & (u("round") < 0.3), F.round(amount / 1000) * 1000).otherwise(F.round(amount, 2))
    trust = F.when(inside, 0.1 + u("corroboration") * 0.4).when(odd, 0.1 + u("corroboration") * 0.6).otherwise(0.3 + u("corroboration") * 0.7)
    days = F.when(inside, _whole(u("day"), 0, 29)).otherwise(_whole(u("day"), 0, 28))
    return many.select(
        F.format_string("EVT-%s-%s%d", "identifiant", F.when(inside, "R").otherwise(""), "k").alias("id_source"),
        F.when(inside, "TRANSACTION").otherwise(_event_kind(odd, u("kind"))).alias("type_evenement"),
        F.when(inside, "INTERNE").otherwise(_pick(("INTERNE", "EXTERNE"), u("source"))).alias("type_source"),
        (F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(days.cast("int"), _whole(u("hour"), 0, 23).cast("int"))).alias("horodatage"),
        amount.alias("montant"), F.col("identifiant").alias("id_entite_source"),
        F.format_string("ENT-%08d", other.cast("bigint")).alias("id_entite_cible"), F.round(trust, 3).alias("score_corroboration"),
        F.when(inside, 1).otherwise(_whole(u("sources"), 1, 3)).cast("int").alias("nombre_sources"),
        F.when(inside, 0).otherwise(_whole(u("jump"), 0, 2)).cast("int").alias("saut_hierarchique"), "adresse_ip",
    )


def edges(ents: DataFrame, seed: int = 42, as_of: str = "2024-07-01") -> DataFrame:
    """Links between entities: shared IP, shared address and cosignature within a ring, and causal ones to random targets.

    Sharing pairs come from equi-joins on the attribute, lower key first; the causal
    targets of an entity are its own draws, so nothing is paired with everything.
    """
    n = ents.count()

    def u(name: str) -> Column:
        return _unit(seed, name, "src", "dst", "type")

    def sharing(attribute: str, kind: str) -> DataFrame:
        a = ents.where(F.col(attribute).isNotNull()).select(F.col("identifiant").alias("src"), attribute)
        b = ents.select(F.col("identifiant").alias("dst"), attribute)
        return a.join(b, attribute).where("src < dst").select("src", "dst", F.lit(kind).alias("type"))

    odd = F.col("categorie") != "NORMAL"
    draws = F.when(odd, _whole(_unit(seed, "links", "identifiant"), 1, 5)).otherwise(_whole(_unit(seed, "links", "identifiant"), 1, 3))
    causal = ents.select(F.col("identifiant").alias("src"), F.explode(F.sequence(F.lit(1).cast("bigint"), draws)).alias("k"))
    target = _whole(_unit(seed, "target", "src", "k"), 0, max(0, n - 1))
    causal = causal.select("src", F.format_string("ENT-%08d", target).alias("dst"), F.lit("CAUSE_DE").alias("type"))
    some = sharing("adresse_ip", "PARTAGE_IP").unionByName(sharing("adresse", "PARTAGE_ADRESSE"))
    some = some.unionByName(sharing("id_reseau", "COSIGNATURE")).unionByName(causal.where("src <> dst").distinct())
    kind = F.col("type")
    low = F.when(kind == "PARTAGE_IP", 0.4).when(kind == "PARTAGE_ADRESSE", 0.3).otherwise(0.1)
    high = F.when(kind.isin("PARTAGE_IP", "CAUSE_DE"), 0.9).when(kind == "PARTAGE_ADRESSE", 0.7).otherwise(0.4)
    return some.select(
        "src", "dst", "type", F.round(low + u("confidence") * (high - low), 3).alias("score_confiance"),
        (F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(_whole(u("age"), 0, 1095).cast("int"))).alias("date_creation"),
        F.when(kind == "CAUSE_DE", u("inactive") < 0.05).otherwise(False).alias("inactif"),
        F.when(kind == "CAUSE_DE", _whole(u("delta"), 60, 72 * 3600).cast("double")).alias("delta_secondes"),
    )
