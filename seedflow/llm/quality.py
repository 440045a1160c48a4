"""Quality rules, line first: judge every line, drop failing lines, then reject documents that lose too much.

Everything is a projection of built-in SQL functions over one row: no shuffle, no Python.

Line rules (a line without a word is neutral and stays as layout):

* punctuation: the line ends with a sentence mark, or has ``LONG_LINE`` words and a sentence mark
  followed by a space (text that was cut inside a sentence);
* navigation: at most ``NAV_WORDS`` words and either two separators ``| > » ·`` standing between
  spaces, or a first word and a whole that are a menu phrase (in English, German, French or Spanish);
* boilerplate: the line holds one of the fixed phrases below, whatever the case of its letters.

A document is kept when the base rules hold and the kept lines hold at least ``1 - MAX_LOSS`` of the
code points in its words.

Defined cases: a null text has no words, so it fails the base rule, and its clean text is empty;
equal rows give equal results; an empty table gives an empty result; the operator reads the two named
columns only, and returns the columns listed in ``measure``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, bound, load

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOSS = 0.3
LONG_LINE = 10
NAV_WORDS = 12
SYMBOLS = "[#*$%&|<>]"

#: Phrases of page furniture, by language of the corpus; every rule applies to every text, whatever its label.
BOILERPLATE = {
    "en": [
        "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "accept cookies",
        "enable javascript", "javascript is disabled", "lorem ipsum", "subscribe to our newsletter", "sign up for our newsletter",
    ],
    "de": [
        "alle rechte vorbehalten", "nutzungsbedingungen", "allgemeine geschäftsbedingungen", "datenschutzerklärung", "cookie-richtlinie",
        "verwendet cookies", "cookies akzeptieren", "javascript aktivieren", "javascript ist deaktiviert", "newsletter abonnieren", "newsletter anmelden",
    ],
    "fr": [
        "tous droits réservés", "conditions d'utilisation", "mentions légales", "politique de confidentialité", "utilise des cookies",
        "accepter les cookies", "activer javascript", "javascript est désactivé", "abonnez-vous à notre newsletter", "inscrivez-vous à notre newsletter",
    ],
    "es": [
        "todos los derechos reservados", "condiciones de uso", "términos de uso", "aviso legal", "política de privacidad", "política de cookies",
        "utiliza cookies", "aceptar cookies", "activar javascript", "javascript está desactivado", "suscríbete a nuestro boletín",
    ],
}
#: Whole lines of menus.
MENU = {
    "en": ["home", "menu", "login", "log in", "sign in", "sign up", "next", "previous", "back to top", "read more", "click here", "skip to content", "share this", "search"],
    "de": ["startseite", "menü", "anmelden", "einloggen", "registrieren", "weiter", "zurück", "nach oben", "weiterlesen", "mehr lesen", "hier klicken", "zum inhalt springen", "teilen", "suche", "suchen", "impressum"],
    "fr": ["accueil", "connexion", "se connecter", "s'inscrire", "suivant", "précédent", "haut de page", "lire la suite", "en savoir plus", "cliquez ici", "aller au contenu", "partager", "rechercher"],
    "es": ["inicio", "menú", "iniciar sesión", "registrarse", "siguiente", "anterior", "volver arriba", "leer más", "haga clic aquí", "saltar al contenido", "compartir", "buscar"],
}

ENDS = r"[.!?:;…。！？][\x22\x27”’»)\]]*[\x20\x09-\x0D]*$"
INSIDE = r"[.!?…][\x22\x27”’»)\]]*[\x20\x09]"
SEPARATED = r"[\x20\x09][|>»·][\x20\x09].*[\x20\x09][|>»·][\x20\x09]"
_MENU = rf"^[{SPACE}]*(?:" + "|".join(p for ps in MENU.values() for p in ps) + rf")[{SPACE}.:>»]*$"
_BOILER = "|".join(p for ps in BOILERPLATE.values() for p in ps)


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def line_ok(line: Column) -> Column:
    """Whether a line with words passes the punctuation, navigation and boilerplate rules."""
    n, low = count_words(line), F.lower(line)
    punctuated = line.rlike(ENDS) | (line.rlike(INSIDE) & (n >= LONG_LINE))
    navigation = (n <= NAV_WORDS) & (line.rlike(SEPARATED) | low.rlike(_MENU))
    return punctuated & ~navigation & ~low.rlike(_BOILER)


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a ``WINDOW``-word window found at least twice among the words.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes. Only where two windows are
    equal are they sorted with their positions; the union of the repeated ones is then summed up in
    one pass. Linear in the words but for that sort.
    """

    def covered(windows: Column) -> Column:
        def spots(ordered: Column) -> Column:
            twice = F.filter(ordered, lambda s, i: (s["h"] == F.get(ordered, i - 1)["h"]) | (s["h"] == F.get(ordered, i + 1)["h"]))
            return F.sort_array(F.transform(twice, lambda s: s["i"]))

        def add(acc: Column, i: Column) -> Column:
            return F.struct((i + WINDOW).alias("end"), (acc["n"] + WINDOW - F.greatest(acc["end"] - i, F.lit(0))).alias("n"))

        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.aggregate(bound(ordered, spots), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), add, lambda acc: acc["n"])

    def hashed(h: Column) -> Column:
        return F.slice(F.transform(h, lambda _, i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])), 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))

    windows = bound(F.transform(words, lambda w: F.xxhash64(w)), hashed)
    return bound(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_bad_lines, kept_chars, clean_text, kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_word = lambda line: line.rlike(f"[^{SPACE}]")
    judged = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), has_word(x).alias("word"), (~has_word(x) | line_ok(x)).alias("ok")))
    counted = bound(F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("repeated")))
    one = docs.select(F.col(id_col), text.alias("_t"), judged.alias("_lines"), counted.alias("_words")).select(
        id_col, "_lines",
        F.col("_words")["n"].alias("n_words"),
        F.char_length(F.regexp_replace("_t", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.col("_words")["repeated"].alias("n_repeat_words"),
    )
    two = one.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_repeat_words",
        bound(F.transform(F.filter("_lines", lambda x: x["word"]), lambda x: x["line"]), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        F.size(F.filter("_lines", lambda x: x["word"])).cast("long").alias("n_lines"),
        F.size(F.filter("_lines", lambda x: ~x["ok"])).cast("long").alias("n_bad_lines"),
        F.array_join(F.transform(F.filter("_lines", lambda x: x["ok"]), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    three = two.withColumn("kept_chars", F.char_length(F.regexp_replace("clean_text", f"[{SPACE}]+", "")).cast("long"))
    return three.withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") >= F.col("word_chars") * (1 - max_loss)))


def clean_documents(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """The kept documents with all their columns; ``text`` is the clean text, ``n_chars`` its length."""
    judged = measure(docs.select(F.struct("*").alias("_row"), "text"), "_row", "text", max_loss)
    columns = [F.col("_row")[c].alias(c) if c not in ("text", "n_chars") else (F.col("clean_text") if c == "text" else F.char_length("clean_text").cast("long")).alias(c) for c in docs.columns]
    return judged.filter("kept").select(*columns)


OUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines", "kept_chars"]


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(load(spark, sf_dir, "documents")).select(*OUT)


_q = lambda s: "'" + s.replace("'", "''") + "'"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{WORD}') AS w FROM d),
win AS (SELECT rid, i, w[i + 1:i + {WINDOW}] AS g FROM (SELECT rid, w, unnest(range(len(w) - {WINDOW - 1})) AS i FROM w WHERE len(w) >= {WINDOW})),
twice AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n_repeat_words FROM twice GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d),
j AS (
  SELECT rid, line, k, regexp_matches(line, '[^{SPACE}]') AS word, len(regexp_extract_all(line, '{WORD}')) AS n, lower(line) AS low FROM l
), judged AS (
  SELECT rid, line, k, word, NOT word OR (
    (regexp_matches(line, {_q(ENDS)}) OR (regexp_matches(line, {_q(INSIDE)}) AND n >= {LONG_LINE}))
    AND NOT (n <= {NAV_WORDS} AND (regexp_matches(line, {_q(SEPARATED)}) OR regexp_matches(low, {_q(_MENU)})))
    AND NOT regexp_matches(low, {_q(_BOILER)})) AS ok FROM j
), lines AS (
  SELECT rid, count(*) FILTER (word) AS n_lines, count(DISTINCT line) FILTER (word) AS d_lines, count(*) FILTER (NOT ok) AS n_bad_lines, string_agg(line, chr(10) ORDER BY k) FILTER (ok) AS clean
  FROM judged GROUP BY rid
), a AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[{SPACE}]+', '', 'g')) AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols,
    n_lines - d_lines AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_lines, n_bad_lines, length(regexp_replace(coalesce(clean, ''), '[{SPACE}]+', '', 'g')) AS kept_chars
  FROM d JOIN w USING (rid) JOIN lines USING (rid) LEFT JOIN rep USING (rid)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND kept_chars >= word_chars * (1 - {MAX_LOSS}::DOUBLE) AS kept
FROM a
"""

QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES = {"op6_quality_rules": SQL}
