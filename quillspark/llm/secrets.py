"""Secret scans: candidate strings, judged by a random forest trained from labelled findings.

Native throughout: candidates are cut from white-space tokens by array functions, so neighbouring words are
array elements; features are length, runs of character classes, dictionary coverage, the candidate's path
(what its token has in front of it) and the neighbouring words; the forest is Spark's own.  Private key blocks
span lines and are found as wholes.

Labelled findings are a table (before2, before1, token, after1, label).  ``labelled_findings`` builds a default one
of fixed size from the shapes that scanners report, true and false; a labelled table of one's own replaces it.

A value may also be spoken ("the password is ...", "was set to ..."): it is a candidate if it mixes letters with digits,
or goes from small to capital letters twice.  ``redact`` masks every whole occurrence of a secret in its text; inside a longer word the same letters stay.

Edge cases: null and empty texts have no candidates; repeated rows give repeated findings; equal candidates of
one text are findings each; very long texts cost in proportion to their words; an empty table gives none; null
doc_ids are carried; other columns are ignored by ``scan`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import WORD_GAP, free, holds_any, materialize, small, table

#: Size of the default training table; trees and depth of the forest; probability from which a finding is a secret.
FINDINGS, TREES, DEPTH, SECRET = 6000, 32, 8, 0.5
#: A candidate: a run of key characters of at least this length inside a token, with a digit or a change of case.
LEAST = 16
CANDIDATE = f"[A-Za-z0-9+/_=.~-]{{{LEAST},}}"
#: A shorter and wider value is a candidate where a secret word is assigned, or as the password of a URL.
KEY_NAME = "(?:secret|token|passw|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|[a-z0-9]_key|auth|bearer|credential|signing)[A-Za-z0-9_.-]*[\"'`\\]]*"
ASSIGNED = "[^\\s\"'`<>]{6,}"
IN_TOKEN = f"(?i)({KEY_NAME}[:=]>?[\"'`]?)({ASSIGNED})"
IN_URL = "(?i)([a-z][a-z0-9+.-]*://[^\\s/:@]*:)([^\\s/]+)@"
#: Words that say a value, the key words that they follow, and what makes a spoken value a candidate.
SAYS = ("is", "was", "to", "ist", "war", "lautet", "est", "es", "era")
SPOKEN_WORDS = "password|passphrase|passcode|passwd|pwd|secret|token|key|apikey|credentials?|passwort|kennwort|passe|contraseña|clave"
SPOKEN_KEY = f"(?i)^[\"'`(]*(?:[A-Za-z0-9]+[_-])?(?:{SPOKEN_WORDS})[\"'`:,]*$"
MIXED = "[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[a-z][A-Z].*[a-z][A-Z]"
#: Any text in which a value can be spoken.
SPOKEN = f"(?i)(?:{SPOKEN_WORDS})[\"'`:,]*\\s+(?:\\S+\\s+(?:set|changed|reset)\\s+)?(?:{'|'.join(SAYS)})\\s"
#: One of these (in lower case) stands in every text that KEY_NAME, or SPOKEN, finds.
KEY_PARTS = ["secret", "token", "passw", "passphrase", "pwd", "key", "auth", "bearer", "credential", "signing"]
SPOKEN_PARTS = ["pass", "pwd", "secret", "token", "key", "credential", "kennwort", "contrase", "clave"]
KEY_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"
MASK = "[SECRET]"

SECRET_WORD = "(?i)(secret|token|passw|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential|signing)"
PUBLIC_WORD = "(?i)(commit|sha-?[0-9]*|md5|checksum|digest|uuid|guid|hash|revision|rev|etag|build|integrity|version|blob|tree|fingerprint|example|sample|dummy|placeholder)"
VENDOR = "^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|AIza|eyJ|hf_|npm_|pypi-|SG\\.|dapi|pplx-|ya29\\.)"
DICTIONARY = "(?i)(account|address|admin|application|author|backup|build|change|client|common|config|content|control|data|default|demo|design|develop|document|download|email|enable|error|example|feature|file|function|global|group|handler|health|hello|home|image|index|info|input|install|item|language|library|list|local|login|main|manager|master|message|method|model|module|name|network|number|object|option|order|output|package|page|param|password|path|plugin|policy|process|product|profile|project|public|query|record|release|report|request|response|result|sample|schema|search|secret|section|server|service|session|setting|simple|source|stack|state|static|status|string|style|system|table|target|template|test|text|token|update|user|value|version|video|view|window|world|www|http|html|json|com|org|net)"

FEATURES = ["length", "runs", "digit_share", "upper_share", "lower_share", "other_share", "hex", "covered", "vendor", "path_slash", "path_assigns", "path_secret", "path_public", "near_secret", "near_public", "near_assigns", "near_says", "after_quote", "uuid", "dotted"]


def features(before2: Column, before1: Column, path: Column, value: Column, after: Column) -> dict[str, Column]:
    """Numeric features of a candidate: its value, its path inside the token, and the words around the token."""
    n = F.length(value)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "\u0001"), "[A-Z]+", "\u0002"), "[a-z]+", "\u0003"), "[^\u0001-\u0003]+", "\u0004")
    near = F.concat_ws(" ", before2, before1)
    share = lambda kind: (n - F.length(F.regexp_replace(value, kind, ""))) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "length": n.cast("double"),
        "runs": F.length(classes) / n,
        "digit_share": share("[0-9]"),
        "upper_share": share("[A-Z]"),
        "lower_share": share("[a-z]"),
        "other_share": share("[^A-Za-z0-9]"),
        "hex": flag(value.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "covered": share(DICTIONARY),
        "vendor": flag(value.rlike(VENDOR)),
        "path_slash": flag(path.rlike("[/\\\\]|https?:") | value.rlike("/[a-z]+/|\\.[a-z]{2,4}$")),
        "path_assigns": flag(path.rlike("[:=]")),
        "path_secret": flag(path.rlike(SECRET_WORD)),
        "path_public": flag(path.rlike(PUBLIC_WORD)),
        "near_secret": flag(near.rlike(SECRET_WORD)),
        "near_public": flag(near.rlike(PUBLIC_WORD)),
        "near_assigns": flag(before1.rlike("[:=]>?$")),
        "near_says": flag(F.lower(before1).isin(*SAYS)),
        "after_quote": flag(path.rlike("[\"'`]$")),
        "uuid": flag(value.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
        "dotted": flag(value.rlike("^[A-Za-z_]+([._-][A-Za-z_]+)+$")),
    }


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Default labelled findings: n rows of true and false shapes with hashed contents, the same in every session."""
    h = lambda k: F.sha2(F.concat_ws("/", F.col("id").cast("string"), F.lit(k)), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(h("b"))), "=+$", "")
    digits = F.regexp_replace(h("d"), "[a-f]", "")
    pick = lambda k, *options: F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64(F.lit(k), F.col("id")), F.lit(len(options))) + 1).cast("int"))
    key = pick("key", "token", "api_key", "secret", "password", "SECRET_KEY", "apikey", "access_key", "auth_token", "client_secret", "private_key")
    public = pick("pub", "commit", "sha1", "sha256", "checksum", "revision", "uuid", "etag", "digest", "build", "md5")
    words = [pick(f"w{i}", "user", "service", "config", "handler", "request", "default", "manager", "project", "system", "template", "example", "value") for i in range(4)]
    uuid = F.concat_ws("-", F.substring(h("u"), 1, 8), F.substring(h("u"), 9, 4), F.substring(h("u"), 13, 4), F.substring(h("u"), 17, 4), F.substring(h("u"), 21, 12))
    size = (F.lit(20) + F.pmod(F.xxhash64(F.lit("size"), F.col("id")), F.lit(24))).cast("int")
    vendor = F.concat(pick("v", "AKIA", "ghp_", "sk-", "glpat-", "xoxb-", "AIza", "hf_", "sk_live_"), F.substring(F.regexp_replace(b64, "[+/]", "x"), F.lit(1), size))
    prefix = pick("v2", "ghp_", "sk-", "glpat-", "hf_", "npm_", "xoxp-", "dapi")
    low_vendor = F.concat(prefix, F.substring(F.translate(h("v2"), "0123456789abcdef", "ghijklmnopqrs014"), F.lit(1), size + 4))
    secret_value = pick("sv", "hex", "b64", "hex40")
    value = F.when(secret_value == "hex", F.substring(h("s"), F.lit(1), size + 8)).when(secret_value == "b64", F.substring(b64, F.lit(1), size)).otherwise(F.substring(h("s"), 1, 40))
    plain = pick("plain", "and", "with", "see", "the", "file", "from", "use", "then")
    quote = pick("q", '"', "'", "")
    short = F.substring(F.regexp_replace(b64, "[+/]", "x"), F.lit(1), F.lit(6) + F.pmod(F.xxhash64(F.lit("short"), F.col("id")), F.lit(10)).cast("int"))
    wide = F.concat(short, pick("mark", "!", "@", "$", "%", "^", "&", "*", "#"), F.substring(h("wide"), F.lit(1), F.lit(1) + F.pmod(F.col("id"), F.lit(8)).cast("int")), pick("mark2", "", "!", "$", "#A", "%b"))
    brief = pick("brief", "short", "wide")
    password = F.when(brief == "short", short).otherwise(wide)
    spoken = F.substring(F.translate(h("spoken"), "0123456789abcdef", "etaoinshrdlucmfp"), F.lit(1), F.lit(6) + F.pmod(F.col("id"), F.lit(9)).cast("int"))
    says = pick("says", "is", "was", "to")
    weak = F.concat(words[0], F.substring(digits, F.lit(1), F.lit(2) + F.pmod(F.col("id"), F.lit(3)).cast("int")))
    release = F.concat(pick("rel", "v", "RS", "sha", "utf", "TLSv", "OAuth"), F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 1), pick("rel2", "-beta", ".4", "-bit", ".x"))
    scheme = pick("scheme", "postgres", "mysql", "mongodb", "redis", "amqp", "https")
    shapes = [
        (1, key, F.lit("="), F.concat(quote, value, quote)),
        (1, key, F.lit(":"), F.concat(quote, value, quote)),
        (1, plain, plain, F.concat(key, F.lit("="), quote, value, quote)),
        (1, plain, plain, F.concat(F.lit('{"'), key, F.lit('":"'), value, F.lit('"}'))),
        (1, F.lit("Authorization:"), F.lit("Bearer"), value),
        (1, plain, plain, vendor),
        (1, plain, F.lit("="), F.concat(quote, vendor, quote)),
        (1, plain, plain, low_vendor),
        (0, plain, public, F.substring(h("c"), 1, 40)),
        (0, public, F.lit("="), F.concat(quote, F.substring(h("c"), F.lit(1), size + 8), quote)),
        (0, plain, public, uuid),
        (0, plain, plain, uuid),
        (0, plain, plain, F.concat(F.lit("https://"), words[0], F.lit(".example.com/"), words[1], F.lit("/"), words[2], F.lit("?id="), F.substring(digits, 1, 8))),
        (0, plain, plain, F.concat(F.lit("/usr/lib/"), words[0], F.lit("/"), words[1], F.lit("_"), words[2], F.lit(".so"))),
        (0, key, F.lit("="), F.concat_ws("_", F.lit("your"), words[0], words[1], words[2])),
        (0, key, F.lit("="), F.concat_ws(".", words[0], words[1], words[2])),
        (0, plain, plain, F.concat(F.initcap(words[0]), F.initcap(words[1]), F.initcap(words[2]))),
        (0, plain, plain, F.concat_ws("-", *words)),
        (0, plain, plain, F.substring(digits, 1, 22)),
        (0, key, F.lit("="), F.repeat(pick("x", "x", "*", "0", "-"), 24)),
        (1, key, F.lit("="), F.concat(quote, password, quote)),
        (1, plain, F.concat(key, F.lit(":")), F.concat(quote, password, quote)),
        (1, plain, plain, F.concat(key, F.lit("="), quote, password, quote)),
        (1, plain, plain, F.concat(scheme, F.lit("://"), words[0], F.lit(":"), password, F.lit("@"), words[1], F.lit("/"), words[2])),
        (1, key, says, F.concat(quote, password, quote)),
        (1, key, F.lit("="), F.concat(quote, weak, quote)),
        (0, key, says, release),
        (0, key, says, F.concat(F.initcap(words[0]), F.initcap(words[1]))),
        (0, plain, F.concat(key, F.lit(":")), spoken),
        (0, plain, plain, F.concat(key, F.lit("="), quote, F.concat_ws("_", words[0], words[1]), quote)),
        (0, key, F.lit("="), F.concat(F.lit("${"), F.upper(words[0]), F.lit("_"), F.upper(words[1]), F.lit("}"))),
        (0, plain, plain, F.concat(key, F.lit("="), quote, F.lit("${"), F.upper(F.translate(F.substring(h("env"), 1, 4), "0123456789", "ghijklmnop")), F.lit("_"), F.upper(words[0]), F.lit("}"), quote)),
        (0, plain, F.concat(key, F.lit("=")), F.concat(quote, F.repeat(pick("x", "x", "*", "0", "-"), 8), quote)),
    ]
    kinds = F.array(*[F.struct(b.alias("before2"), a.alias("before1"), t.alias("token"), plain.alias("after1"), F.lit(y).cast("double").alias("label")) for y, b, a, t in shapes])
    return spark.range(n).select(F.element_at(kinds, (F.col("id") % len(shapes) + 1).cast("int")).alias("f")).select("f.*")


def _cut(token: Column, before2: Column | None = None, before1: Column | None = None) -> Column:
    """Array of struct(path, value, given) of a token's candidates: each value with all that stands before it in the token.

    ``given`` values are assigned to a secret word, in the token or by the words before it, or a URL's password.
    """
    values = F.regexp_extract_all(token, F.lit(f"({CANDIDATE})"), F.lit(1))
    # a value that starts with its own assignment (key=value) is cut after it
    long = F.transform(values, lambda v: F.struct(F.concat(F.call_function("substring_index", token, v, F.lit(1)), F.regexp_extract(v, "^([A-Za-z_.-]{2,24}=(?=[^=]))", 1)).alias("path"), F.rtrim(F.regexp_replace(v, "^[A-Za-z_.-]{2,24}=(?=[^=])", ""), F.lit(".-~")).alias("value"), F.lit(False).alias("given")))
    none = F.array().cast("array<string>")
    inside = F.when(token.rlike("[:=]"), F.concat(F.regexp_extract_all(token, F.lit(IN_TOKEN), F.lit(2)), F.regexp_extract_all(token, F.lit(IN_URL), F.lit(2)))).otherwise(none)
    after = none
    if before1 is not None:
        follows = F.regexp_extract_all(token, F.lit(f"^[\"'`(]*({ASSIGNED})"), F.lit(1))
        said = F.filter(F.transform(follows, lambda v: F.rtrim(v, F.lit(".,;:)}]"))), lambda v: (F.length(v) >= 6) & v.rlike(MIXED))
        after = F.when(_assigns(before2, before1), follows).when(_says(before2, before1), said).otherwise(none)
    bare = F.transform(F.concat(inside, after), lambda v: F.rtrim(v, F.lit(",;)}]")))
    fresh = F.filter(F.array_distinct(bare), lambda v: (F.length(v) > 0) & v.rlike("[A-Za-z0-9]") & ~F.exists(long, lambda x: x["value"] == v))
    return F.concat(long, F.transform(fresh, lambda v: F.struct(F.call_function("substring_index", token, v, F.lit(1)).alias("path"), v.alias("value"), F.lit(True).alias("given"))))


def _assigns(before2: Column, before1: Column) -> Column:
    """Whether the two words before a token assign it to a secret word."""
    one = before1.rlike("[:=]>?[\"'`]?$") & before1.rlike(f"(?i){KEY_NAME}[:=]>?[\"'`]?$")
    two = before1.rlike("^(:|=|:=|=>)$") & before2.rlike(f"(?i){KEY_NAME}$")
    return F.coalesce(one, F.lit(False)) | F.coalesce(two, F.lit(False))


def _says(before2: Column, before1: Column) -> Column:
    """Whether the two words before a token say that it is the value of a secret word."""
    return F.coalesce(F.lower(before1).isin(*SAYS) & before2.rlike(SPOKEN_KEY), F.lit(False))


def _plausible(value: Column) -> Column:
    return (F.length(value) >= LEAST) & value.rlike("[0-9]|[a-z][A-Z]|[A-Z][a-z].*[A-Z]|[_./-]") & value.rlike("[A-Za-z0-9]")


def train(labelled: DataFrame) -> RandomForestClassificationModel:
    """Fit the forest on a table of labelled findings."""
    one = labelled.select("label", "before2", "before1", "after1", F.explode(_cut(F.col("token"), F.col("before2"), F.col("before1"))).alias("c")).filter(F.col("c.given") | _plausible(F.col("c.value")))
    x = one.select("label", *[c.alias(k) for k, c in features(F.col("before2"), F.col("before1"), F.col("c.path"), F.col("c.value"), F.col("after1")).items()])
    data = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(x).select("label", "x").coalesce(1)
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7).fit(data)


def _may_hold(text: Column) -> Column:
    """Whether a text can hold a candidate; what each pattern cannot do without is looked for first."""
    assigned = (text.contains(":") | text.contains("=")) & holds_any(text, KEY_PARTS) & text.rlike(f"(?i){KEY_NAME}\\s*[:=]")
    url = text.contains("://") & text.contains("@") & text.rlike(IN_URL)
    return text.rlike(CANDIDATE) | assigned | url | (holds_any(text, SPOKEN_PARTS) & text.rlike(SPOKEN))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, word (0-based), before2, before1, after1, path, value of every candidate of every text."""
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(_may_hold(F.col("text"))).select("doc_id", F.split("text", WORD_GAP).alias("w"))
    w = F.col("w")
    get = lambda i: F.when(i >= 0, F.get(w, i))
    # "password was set to" reads as "password to"
    second = lambda i: F.when((F.lower(get(i - 1)) == "to") & F.lower(get(i - 2)).isin("set", "changed", "reset") & get(i - 4).rlike(SPOKEN_KEY), get(i - 4)).otherwise(get(i - 2))
    one = lambda t, i: ((F.length(t) >= LEAST) & t.rlike(CANDIDATE)) | (t.rlike("[:=]") & (t.rlike(IN_TOKEN) | t.rlike(IN_URL))) | _assigns(get(i - 2), get(i - 1)) | _says(second(i), get(i - 1))
    at = F.filter(F.transform(w, lambda t, i: F.when(one(t, i), i)), lambda i: i.isNotNull())
    found = words.select("doc_id", F.explode(F.transform(at, lambda i: F.struct(i.alias("word"), second(i).alias("before2"), get(i - 1).alias("before1"), F.get(w, i).alias("token"), F.get(w, i + 1).alias("after1")))).alias("f"))
    return found.select("doc_id", "f.*").withColumn("c", F.explode(_cut(F.col("token"), F.col("before2"), F.col("before1")))).filter(F.col("c.given") | _plausible(F.col("c.value"))).select("doc_id", "word", "before2", "before1", "after1", "c.path", "c.value")


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """Every candidate with its probability: doc_id, word, kind, value_sha256, length, probability, is_secret, value."""
    model = model or train(labelled_findings(docs.sparkSession))
    found = candidates(docs)
    x = found.select("doc_id", "word", "value", *[c.alias(k) for k, c in features(F.col("before2"), F.col("before1"), F.col("path"), F.col("value"), F.col("after1")).items()])
    judged = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(x))
    p = F.round(F.element_at(vector_to_array("probability"), 2), 6)
    scored = judged.select("doc_id", "word", F.when(F.col("vendor") == 1, "vendor").otherwise("generic").alias("kind"), "value", p.alias("probability"))
    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"({KEY_BLOCK})"), F.lit(1))).alias("value")).select("doc_id", F.lit(None).cast("int").alias("word"), F.lit("key_block").alias("kind"), "value", F.lit(1.0).alias("probability"))
    both = scored.unionByName(blocks)
    return both.select("doc_id", "word", "kind", F.sha2("value", 256).alias("value_sha256"), F.length("value").cast("long").alias("length"), "probability", (F.col("probability") >= SECRET).alias("is_secret"), "value")


def _mask(text: Column, secret: Column) -> Column:
    """``text`` with the whole occurrences of ``secret`` masked: no letter or digit goes on where the secret ends in one."""
    left = F.when(secret.rlike("^[A-Za-z0-9]"), "(?<![A-Za-z0-9])").otherwise("")
    right = F.when(secret.rlike("[A-Za-z0-9]$"), "(?![A-Za-z0-9])").otherwise("")
    quoted = F.concat(F.lit("\\Q"), F.replace(secret, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.regexp_replace(text, F.concat(left, quoted, right), F.lit(MASK))


def redact(docs: DataFrame, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mask and ``n_chars``, if there, recounted.

    Secrets reach their rows as one array for each key of doc_id and text, by a left join of the few that have any;
    if their measured size allows it, the texts are not shuffled for that.
    """
    key = F.xxhash64("doc_id", "text")
    mine, mark = free(docs, "_secret_doc"), free(docs, "_secrets")
    secrets = scan(docs.select(key.alias("doc_id"), "text"), model).filter("is_secret").groupBy(F.col("doc_id").alias(mine)).agg(F.transform(F.sort_array(F.collect_set(F.struct(F.length("value"), "value")), asc=False), lambda x: x["value"]).alias(mark))
    secrets = materialize(secrets, "secrets")
    side = F.broadcast(secrets) if small(secrets, F.octet_length(F.array_join(mark, "")) + F.size(mark) * 40 + 64) else secrets
    joined = docs.join(side, key == F.col(mine), "left")
    text = F.aggregate(F.coalesce(mark, F.array().cast("array<string>")), F.col("text"), _mask)
    out = joined.withColumn("text", F.when(F.col(mark).isNotNull(), text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(mark).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("value")


QUERIES = {"op2_secrets": op2_secrets}
ORACLE_SQL: dict[str, str] = {}
