"""Secret scans: fixed patterns, and character Markov models (DataFrame functions only).

Two first-order Markov models over characters, one of random strings and one of
ordinary words and identifiers, are counted from labelled samples.  A long token
is a secret if random strings explain it better: if the mean log-likelihood
ratio of its transitions is above MARGIN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base patterns, in the order in which kinds are listed.
BASE = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
#: Least length of the value (assign) or of the match.
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Tokens that the models judge: all of at least LONG of these characters.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LONG, MARGIN = 12, 0.0
#: Parts of a text whose matches are gathered at once.
BLOCK = 256
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LONG},}}"

#: Words that identifiers are made of.
WORDS = (
    "account action address amount apply array async base batch block body buffer build bytes cache call channel "
    "check child class client code color column command common config connect content context copy count create "
    "current data date default delete detail device direct document edit element email enable engine entry error "
    "event example export field file filter final first format frame function global group handle header height "
    "history home image import index info input insert internal invoice item key label language last layout length "
    "level library line link list load local location login main manager mark master match member memory menu "
    "message method model module month name network node note number object offset open option order output owner "
    "page panel parent part path pattern payment phone place point policy position post price print process product "
    "profile project query queue range read record reference region release remote report request reset resource "
    "response result return role root route row rule save scale schema screen search section select sender series "
    "server service session setting shape shared size sort source space stage start state status step storage store "
    "stream string style subject summary support switch system table target task template test text theme thread "
    "time title total trace track transfer tree type unit update upload user utility valid value version view "
    "visible width window word worker write year zone"
).split()

#: Ordinary words of several languages, most of them long; only the letters A to Z.
PROSE = (
    "accommodation acknowledgement administration advertisement agricultural approximately architecture "
    "characteristic circumstances communication comprehensive congratulations consciousness consequently "
    "consideration contemporary contribution controversial conventional correspondence demonstration determination "
    "development disappointment distinguished electricity encouragement entertainment enthusiastic environmental "
    "establishment extraordinary furthermore governmental grandchildren headquarters housekeeping hydrogen "
    "immediately imagination independence infrastructure instrumental intelligence investigation jurisdiction "
    "kindergarten knowledge laboratory legislative lightweight manufacturing mathematics measurement neighbourhood "
    "nevertheless northwestern occasionally opportunity organization overwhelming parliamentary particularly "
    "performance philosophical photographer possibility psychological qualification questionnaire recommendation "
    "relationship representative responsibility revolutionary sophisticated straightforward strengthened "
    "subsequently successfully symptomatically technological temperature thoughtfulness throughout transformation "
    "transportation unbelievable understanding unfortunately vulnerability weatherproof whatsoever wholehearted "
    "worthwhile yesterday "
    "abgeschlossen arbeitslosigkeit aufmerksamkeit ausgezeichnet bedeutungsvoll beispielsweise bundesrepublik "
    "durchschnittlich entscheidung entwicklung erfahrungen fachhochschule freundschaft geburtstag "
    "geschwindigkeit gesellschaft gesundheitswesen grundlagenforschung hauptbahnhof jahrhundert krankenhaus "
    "krankenversicherung landwirtschaft lebensmittel menschlichkeit mitgliedschaft nachrichten notwendigkeit "
    "rechtschreibung schifffahrt schmetterling schwierigkeiten selbstverwaltung sicherheitsdienst sprachwissenschaft "
    "verantwortung verschiedene vollkommen wahrscheinlichkeit weihnachtsbaum "
    "wirtschaftswachstum wissenschaftler zeitschrift zusammenarbeit zwischenzeit "
    "accompagnement actuellement apprentissage aujourd bouleversement chaussures communautaire "
    "connaissance conseiller construction doucement enseignement enthousiasme environnement "
    "essentiellement extraordinaire fonctionnement gouvernement heureusement immeubles investissement "
    "lendemain longtemps malheureusement naturellement normalement particulier prochainement quelquefois "
    "rapidement renseignement seulement soixante souvenirs toujours travailleur vraisemblable "
    "acontecimiento administrativo agradecimiento aproximadamente ayuntamiento bachillerato comportamiento "
    "conocimiento construir correspondiente desarrollo descubrimiento desgraciadamente diferencia "
    "establecimiento extranjero funcionamiento guerrillero inmediatamente investigador llamamiento "
    "mantenimiento maravilloso movimiento necesariamente pensamiento perfeccionamiento presupuesto "
    "quebrantahuesos reconocimiento responsabilidad sencillamente sentimiento trabajadores universidad "
    "avvenimento bellezza cambiamento certamente chiacchierare cittadinanza conoscenza difficilmente "
    "giornalista insegnamento meraviglioso naturalmente ringraziamento soggiorno specialmente stabilimento "
    "aantrekkelijk bijvoorbeeld geschiedenis gezelligheid maatschappelijk ontwikkeling tegenwoordig "
    "verantwoordelijk verschillende waarschijnlijk ziekenhuis "
    "apfelbaum aufpassen empfehlung empfindlich gesetzgebung grundsatz kopfschmerzen letztendlich netzwerk pflanzen "
    "pflicht platzregen rechtsschutz schutzgebiet setzen sprechzimmer tatsache umsetzung zuletzt "
    "animaux aieux bateaux cailloux chevaux dangereux eaux evaluation feuilleton heureux jeux journaux joueuse lieux "
    "malheureux merveilleux mouillage mousseux nationaux nouveaux oiseaux ouailles ouest oui religieux rouage "
    "serieux travaux vieux yeux "
    "lorem ipsum dolor amet consectetur adipiscing eiusmod tempor incididunt labore magna aliqua veniam quis "
    "nostrud exercitation ullamco laboris aliquip commodo consequat reprehenderit voluptate velit fugiat pariatur "
    "excepteur occaecat cupidatat proident sunt culpa officia deserunt mollit laborum"
).split()


def labelled_samples(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """(random, value): random strings of common alphabets, identifiers made of WORDS, and plain tokens; from a rule.

    Plain tokens are PROSE in small, first-capital and capital letters, numbers and runs of one sign.
    """
    ids = spark.range(rows)
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 512)
    raw = F.base64(F.unhex(digest))
    size = F.pmod(F.xxhash64("id"), F.lit(25)) + 16
    text = (
        F.when(F.col("id") % 4 == 0, digest)
        .when(F.col("id") % 4 == 1, F.upper(F.translate(raw, "+/=", "")))
        .when(F.col("id") % 4 == 2, F.translate(raw, "+/=", "xY7"))
        .otherwise(raw)
    )
    random = ids.select(F.lit(True).alias("random"), F.substring(text, F.lit(1), size.cast("int")).alias("value"))
    words = F.array(*[F.lit(w) for w in WORDS])
    word = lambda k: F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))).cast("int"))
    number = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(2100)).cast("string")
    lower = F.array(word(0), word(1), word(2))
    date = F.date_format(F.date_add(F.lit("2015-01-01"), (F.col("id") % 3000).cast("int")), "yyyy-MM-dd")
    made = (
        F.when(F.col("id") % 6 == 0, F.concat(F.array_join(lower, "_"), F.lit("_"), number))
        .when(F.col("id") % 6 == 1, F.upper(F.concat(F.array_join(lower, "_"), F.lit("_"), number)))
        .when(F.col("id") % 6 == 2, F.concat(word(0), F.initcap(word(1)), F.initcap(word(2)), number))
        .when(F.col("id") % 6 == 3, F.concat(F.array_join(lower, "-"), F.lit("-"), number))
        .when(F.col("id") % 6 == 4, F.concat(F.array_join(lower, "/"), F.lit("/"), word(3), number))
        .otherwise(F.concat(word(0), F.lit("-"), date, F.lit("-"), word(1)))
    )
    prose = F.array(*[F.lit(w) for w in PROSE])
    one = F.get(prose, F.pmod(F.xxhash64("id", F.lit(20)), F.lit(len(PROSE))).cast("int"))
    two = F.get(prose, F.pmod(F.xxhash64("id", F.lit(21)), F.lit(len(PROSE))).cast("int"))
    sign = F.substring(F.lit("+/_=-"), F.pmod("id", F.lit(5)).cast("int") + 1, F.lit(1))
    plain = (
        F.when(F.col("id") % 8 < 3, one)
        .when(F.col("id") % 8 == 3, F.initcap(one))
        .when(F.col("id") % 8 == 4, F.upper(one))
        .when(F.col("id") % 8 == 5, F.concat_ws("-", F.initcap(one), two))
        .when(F.col("id") % 8 == 6, F.abs(F.xxhash64("id", F.lit(22))).cast("string"))
        .otherwise(F.repeat(sign, size.cast("int")))
    )
    return random.union(ids.select(F.lit(False), made)).union(ids.select(F.lit(False), plain))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of every transition, row by row, from labelled samples.

    The counts are at most 2 * len(ALPHABET)**2 rows.  Null values and
    characters outside the alphabet are passed over; every transition is
    counted once more than seen.
    """
    value = F.coalesce(F.col("value"), F.lit(""))
    places = samples.filter(F.length(value) > 1).select(
        "random", "value", F.explode(F.sequence(F.lit(1), F.length("value") - 1)).alias("k")
    )
    at = lambda k: F.instr(F.lit(ALPHABET), F.substring(F.col("value"), k, F.lit(1)))
    pairs = places.select("random", at(F.col("k")).alias("a"), at(F.col("k") + 1).alias("b"))
    counted = pairs.filter("a > 0 and b > 0 and random is not null").groupBy("random", "a", "b").count().collect()
    n = len(ALPHABET)
    tables = {True: [[1.0] * n for _ in range(n)], False: [[1.0] * n for _ in range(n)]}
    for random, a, b, count in counted:
        tables[random][a - 1][b - 1] += count
    ratio = []
    for mine, other in zip(tables[True], tables[False], strict=True):
        up, down = sum(mine), sum(other)
        ratio += [math.log(x / up) - math.log(y / down) for x, y in zip(mine, other, strict=True)]
    return ratio


def log_ratio(value: Column, ratio: list[float]) -> Column:
    """Mean log-likelihood ratio of the transitions of ``value`` (2 characters or more, all in ALPHABET)."""
    table = F.from_json(F.lit(str([round(x, 6) for x in ratio])), "array<double>")
    n = len(ALPHABET)

    def step(s, c):
        code = F.instr(F.lit(ALPHABET), c) - 1
        rise = F.when(s["last"] >= 0, F.get(table, s["last"] * n + code)).otherwise(F.lit(0.0))
        return F.struct((s["sum"] + rise).alias("sum"), code.alias("last"))

    # One pass over the characters; a place in a string would be sought from its beginning.
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"))
    return F.aggregate(F.split(value, ""), start, step, lambda s: s["sum"]) / (F.length(value) - 1)


def find_all(text: Column, pattern: str) -> Column:
    """Array of (start, end, piece) of the leftmost non-overlapping matches, in code points.

    Matches are put between marks and the text is split there: every other part
    is a match.  Marks that are in the text count as other characters; no pattern
    here matches either.
    """
    mark = "\u0001"
    marked = F.regexp_replace(F.translate(text, mark, "\u0002"), F.lit(f"({pattern})"), F.lit(f"{mark}$1{mark}"))
    none = F.array().cast("array<struct<start:int,end:int,piece:string>>")

    def step(s, p):
        end = s["at"] + F.length(p)
        match = F.array(F.struct(s["at"].alias("start"), end.alias("end"), p.alias("piece")))
        found = F.when(s["hit"], F.concat(s["found"], match)).otherwise(s["found"])
        return F.struct(end.alias("at"), (~s["hit"]).alias("hit"), found.alias("found"))

    def block(before, some):
        return F.aggregate(some, F.struct(before["at"].alias("at"), before["hit"].alias("hit"), none.alias("found")), step)

    def positions(parts):
        # Block by block, so that the arrays that grow part by part stay short.
        first = F.array(F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), none.alias("found")))
        blocks = F.aggregate(
            F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")),
            first,
            lambda done, k: F.concat(done, F.array(block(F.element_at(done, -1), F.slice(parts, k * BLOCK + 1, BLOCK)))),
        )
        return F.when(F.size(parts) > 1, F.flatten(F.transform(blocks, lambda b: b["found"]))).otherwise(none)

    # The parts are bound to a name, or else they would be made again for every block.
    return F.transform(F.array(F.split(marked, mark, -1)), positions)[0]


def scan_secrets(docs: DataFrame, ratio: list[float]) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans read kind:start:end in code points, end exclusive, by start and then
    kind; the models' kind is ``random``, for tokens that touch no base span.
    Null texts count as empty; repeated rows keep a row each; an empty table
    gives an empty result.  Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def kept(kind: str, order: int) -> Column:
        def long_enough(m):
            value = F.regexp_extract(m["piece"], BASE[kind], 2) if kind == "assign" else m["piece"]
            return F.length(value) >= LEAST[kind]

        # Runs shorter than the least length never pass, so the pattern may ask for it.
        pattern = BASE[kind] if kind == "assign" else f"{BASE[kind][:-1]}{{{LEAST[kind] - 4 * (kind == 'access')},}}"
        return F.transform(
            F.filter(find_all(F.col("text"), pattern), long_enough),
            lambda m: F.struct(
                m["start"].alias("start"), F.lit(order).alias("place"), m["end"].alias("end"), F.lit(kind).alias("kind")
            ),
        )

    shown = lambda spans: F.array_join(
        F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ","
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = rows.select(
        "doc_id",
        *[kept(kind, k).alias(kind) for k, kind in enumerate(BASE)],
        find_all(F.col("text"), TOKEN).alias("tokens"),
    )
    based = found.withColumn("base", F.array_sort(F.concat(*BASE)))
    judged = F.filter(
        "tokens",
        lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"]))
        & (log_ratio(m["piece"], ratio) > MARGIN),
    )
    added = F.transform(
        judged,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(len(BASE)).alias("place"), m["end"].alias("end"), F.lit("random").alias("kind")
        ),
    )
    return based.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
        shown(F.array_sort(F.concat("base", added))).alias("spans"),
    )
