"""Quality rules, line first: rules judge each line, failing lines go, and a document that loses too much goes.

Native expressions only.  Per document: word and symbol counts, repeated lines, and words inside repeated
three-word windows (windows are hashed, sorted with their positions inside the row, and the union of the repeated
ones is summed, so nothing is shuffled).  Per line: closing punctuation, navigation, boilerplate, letters
and symbols; a line that repeats an earlier one is lost as well.

Edge cases: a null or empty text has no words and fails; a very long text costs in proportion to its words (and their
sorting); repeated rows give equal rows; an empty table gives
none; null doc_ids are carried; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import holds_any, table, words_column

#: Characters of failing lines, as a share of all, that a kept document may lose.
MAX_LOST = 0.4
#: A line of fewer words needs closing punctuation.
SHORT_LINE = 4
SYMBOLS = "#*$%&|<>"
#: The characters of WORD_GAP.
GAPS = " \t\n\x0b\x0c\r"
GAP = r"\x20\x09-\x0D"
CLOSING = r"[.!?;:…。！？]['\"”’»)\]]*$"
#: Lines that are a menu's word (English, German, French, Spanish) or a chain of them, and phrases of boilerplate.
NAVIGATION = r"(?i)^(home|menu|next|previous|prev|back|top|login|log in|sign in|sign up|register|search|share|print|read more|more|skip to content|startseite|weiter|zurück|nach oben|anmelden|registrieren|suche|suchen|teilen|drucken|weiterlesen|mehr|mehr lesen|accueil|suivant|précédent|retour|haut de page|connexion|se connecter|inscription|recherche|rechercher|partager|imprimer|lire la suite|plus|inicio|siguiente|anterior|volver|arriba|iniciar sesión|acceder|registrarse|buscar|compartir|imprimir|leer más|más)[^\p{L}\p{N}]*$|(\s[|»›>]\s.*){2,}"
BOILERPLATE = r"(?i)all rights reserved|\bcookies?\b.{0,40}\b(policy|consent|accept|use)\b|terms of (use|service)|privacy policy|enable javascript|\blorem ipsum\b|click here|subscribe to our|licensed under|copyright (©|\(c\)|[0-9]{4})|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|klicken sie hier|newsletter abonnieren|tous droits réservés|politique de confidentialité|conditions d'utilisation|cliquez ici|abonnez-vous|todos los derechos reservados|política de privacidad|condiciones de uso|haga clic aquí|suscríbase"

#: One of these (in lower case) stands in every line that BOILERPLATE finds.
BOILERPLATE_PARTS = ["rights reserved", "cookie", "terms of ", "privacy policy", "enable javascript", "lorem ipsum", "click here", "subscribe to our", "licensed under", "copyright ", "rechte vorbehalten", "datenschutzerkl", "nutzungsbedingungen", "klicken sie hier", "newsletter abonnieren", "droits r", "confidentialit", "conditions d'utilisation", "cliquez ici", "abonnez-vous", "todos los derechos", "tica de privacidad", "condiciones de uso", "haga clic aqu", "suscr"]
#: As many gaps between words as make SHORT_LINE words.
LONG_LINE = rf"(?:[{GAP}]++[^{GAP}]++){{{SHORT_LINE - 2}}}[{GAP}]"


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the array."""
    n = F.size(words)
    hashed = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.xxhash64(F.slice(words, i, 3)).alias("h"), i.alias("i")))
    ordered = F.sort_array(hashed)
    return F.when(n >= 4, ordered)


def document_rules(docs: DataFrame) -> DataFrame:
    """The base columns of every row: doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    worded = base.withColumn("words", words_column(text)).withColumn("lines", lines)
    sorted_ = worded.withColumns({"n_words": F.size("words").cast("long"), "grams": repeat_words(F.col("words"))})
    g = F.col("grams")
    at = F.transform(
        F.filter(
            F.transform(g, lambda x, j: F.when((F.try_element_at(g, j + 2)["h"] == x["h"]) | ((j > 0) & (F.try_element_at(g, F.greatest(j, F.lit(1)))["h"] == x["h"])), x["i"])),
            lambda i: i.isNotNull(),
        ),
        lambda i: i,
    )
    marked = sorted_.withColumn("at", F.sort_array(at)).drop("grams")
    p = F.col("at")
    covered = F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return marked.select(
        "doc_id",
        "text",
        "lines",
        "n_words",
        F.length(F.translate(text, GAPS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def line_fails(line: Column) -> Column:
    """Whether a line (with a word in it) is not prose."""
    trimmed = F.trim(line)
    short = ~trimmed.rlike(LONG_LINE)
    letters = F.length(F.regexp_replace(trimmed, r"[^\p{L}\p{N}\s]", ""))
    symbols = F.length(trimmed) - F.length(F.translate(trimmed, SYMBOLS, ""))
    return (short & ~trimmed.rlike(CLOSING)) | (10 * symbols > F.length(trimmed)) | trimmed.rlike(NAVIGATION) | (holds_any(trimmed, BOILERPLATE_PARTS) & trimmed.rlike(BOILERPLATE)) | (2 * letters < F.length(trimmed))


def clean(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """All rules of every row: the base columns, cleaned (the text without failing lines), lost, kept."""
    good = F.filter(F.array_distinct("lines"), lambda x: ~line_fails(x))
    ruled = document_rules(docs).withColumn("cleaned", F.array_join(good, "\n")).drop("lines")
    chars = F.length(F.translate("cleaned", GAPS, ""))
    lost = F.when(F.col("word_chars") > 0, 1 - chars / F.col("word_chars")).otherwise(1.0)
    judged = ruled.withColumn("lost", lost).withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost))
    # a filter on the results stays above the generator: below it, it would compute all rules once more in itself
    return judged.select(F.explode(F.array(F.struct(*judged.columns))).alias("x")).select("x.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("lost", 6).alias("lost"))


def _oracle() -> str:
    sql = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    gap = r"'[\x20\x09-\x0D]+'"
    fails = f"""(len(list_filter(string_split_regex(trim(x), {gap}), lambda y: true)) < {SHORT_LINE} AND NOT regexp_matches(trim(x), {sql(CLOSING)}))
      OR 10 * length(regexp_replace(trim(x), '[^#*$%&|<>]', '', 'g')) > length(trim(x)) OR regexp_matches(trim(x), {sql(NAVIGATION)}) OR regexp_matches(trim(x), {sql(BOILERPLATE)})
      OR 2 * length(regexp_replace(trim(x), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')) < length(trim(x))"""
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, text, list_filter(string_split_regex(text, {gap}), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
b AS (SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  list_filter(list_filter(ls, lambda x, i: list_position(ls, x) = i), lambda x: NOT ({fails})) AS good FROM w LEFT JOIN cov ON cov.r = w.r),
c AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CASE WHEN word_chars > 0 THEN 1 - coalesce(list_sum(list_transform(good, lambda x: length(regexp_replace(x, {gap}, '', 'g')))), 0) / word_chars ELSE 1.0 END AS lost FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= {MAX_LOST} AS kept, round(lost::DOUBLE, 6) AS lost FROM c"""


QUERIES = {"op9_quality": op9_quality}
ORACLE_SQL = {"op9_quality": _oracle()}
