"""Secret scans with a random forest that removes false positives, with DataFrame functions and Spark ML only.

Texts are cut into pieces at blanks, quotes, brackets and separators, and after the = or : of an assignment. Candidates are
long pieces of mixed characters, and what stands behind a telling name. Features: length, character transitions, dictionary
coverage, the path and the neighbouring words. The forest is trained on labelled findings.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of the shortest candidate, and of the shortest behind a telling name.
SHORTEST, SHORTEST_NAMED = 16, 6
#: Labelled findings that the forest is fitted on at most.
MOST_LABELLED = 4000
TREES, TREE_DEPTH, SEED = 20, 6, 17
#: A finding of at least this score is a secret.
CUT = 0.5
#: Where texts are cut: blanks and separators, or behind the = or : that gives a value, not within ==, :: or ://.
CUTS = r"[\x20\x09-\x0D\"'(){}\[\],;&?<>`|]+|(?<=[^=:][=:])(?=[^=:/])"
#: A long piece is a candidate if it has only these characters and mixes letters with digits, or cases inside.
LONG = r"^[A-Za-z0-9+/_.\-~!@#$%^*]+={0,2}$"
#: Characters of a neighbouring piece that count, those next to the candidate.
NEIGHBOUR = 80
#: What stands before a value that a name tells of.
NAMED = r"(?i)(?:key|token|secret|passw|passphrase|pwd|auth|credential|bearer|private)[\w.\-]*\s*(?:[=:]+|\sis|\sbearer)$|\bbearer$|://[^/\s]*:$"
TELLING = r"(?i)(?:key|token|secret|passw|pwd|auth|credential|bearer|private)"
HARMLESS = r"(?i)(?:example|sample|dummy|test|fake|placeholder|commit|sha256|sha1|md5|checksum|digest|etag|version|uuid|hash)"
PATHLIKE = r"(?i)(?:/|\\|\.(?:md|txt|html?|json|ya?ml|py|js|java|png|jpe?g|css|lock)$)"
#: Words that secrets rarely hold.
WORDS = """
access account action admin agent alpha api app auth base beta block body book build button cache call change check class
client cloud code color column config content context control copy count create current custom data date debug default
delete demo detail device display document domain dummy edit email enable error event example fake field file filter
first format frame from function get global group handler header height hello hidden home host image index info input
internal item key label language last layout length level library line link list load local lock login main manager map
max media menu message method min mode model module name network next node number object option order output page parent
password path placeholder plugin point port post private process product profile project property public query read
record release remote report request resource response result role root route sample save schema script search secret
section select server service session set size source start state static status string style submit system table target
task template test text theme time title token tool type update upload url user value version view web width window word
""".split()
#: The letter pairs that are most frequent in running text.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()
FEATURES = ["length", "changes", "digits", "uppers", "vowels", "variety", "letter_pairs", "hexadecimal", "coverage", "separators", "path_like", "telling", "harmless", "assigned"]


def described(findings: DataFrame) -> DataFrame:
    """Adds the FEATURES to rows of value, before, after (neighbouring words) and path; nulls count as empty."""
    value, before, after, path = (F.coalesce(c, F.lit("")) for c in ("value", "before", "after", "path"))
    lowered, size = F.lower(value), F.greatest(F.length(value), F.lit(1)).cast("double")
    kinds = F.translate(value, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.-=", "a" * 26 + "A" * 26 + "0" * 10 + "-" * 6)
    share = lambda pattern, text=lowered: F.regexp_count(text, F.lit(pattern)) / size
    return findings.withColumns(
        {
            "length": size,
            "changes": F.regexp_count(kinds, F.lit(r"a(?=[^a])|A(?=[^A])|0(?=[^0])|-(?=[^\-])")) / size,
            "digits": share("[0-9]"),
            "uppers": share("[A-Z]", value),
            "vowels": share("[aeiou]"),
            "variety": F.size(F.array_distinct(F.split(value, ""))) / size,
            "letter_pairs": share("|".join(PAIRS)),
            "hexadecimal": lowered.rlike("^[0-9a-f]+$").cast("double"),
            "coverage": 1 - F.length(F.regexp_replace(lowered, "|".join(sorted(WORDS, key=lambda w: (-len(w), w))), "")) / size,
            "separators": share(r"[/_.\-]"),
            "path_like": F.concat(path, F.lit(" "), F.concat(before, F.lit(""))).rlike(PATHLIKE).cast("double"),
            "telling": before.rlike(TELLING).cast("double"),
            "harmless": F.concat_ws(" ", before, after, path).rlike(HARMLESS).cast("double"),
            "assigned": before.rlike(r"[=:]\s*[\"']?$").cast("double"),
        }
    )


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, at (piece number), value, before, after and path of each candidate in each row's whole text; path is the source.

    Every value of a word counts, such as of a query string or of compact JSON. Of a value before an @ behind ``://name:``
    the part before the last @ counts. Null texts and texts without a candidate give no row; a repeated row gives its
    candidates again.
    """
    rows = documents.where("text is not null").select("doc_id", F.col("source").alias("path"), F.split("text", CUTS).alias("pieces"))
    near = lambda i, k: F.coalesce(F.get("pieces", i + k), F.lit(""))
    told = lambda i: F.concat_ws(" ", F.right(near(i, -2), F.lit(NEIGHBOUR)), F.right(near(i, -1), F.lit(NEIGHBOUR)))

    def likely(x: Column) -> Column:
        word, long_one = x["word"], F.length(x["word"]) >= SHORTEST
        given = near(x["at"], -1).rlike("[=:]$|(?i)^(?:is|bearer)$")
        mixes = (word.rlike("[0-9]") & word.rlike("[A-Za-z]")) | word.rlike("[a-z][A-Z]")
        return (long_one & mixes & word.rlike(LONG)) | (given & (F.length(word) >= SHORTEST_NAMED) & told(x["at"]).rlike(NAMED))

    def found(x: Column) -> Column:
        before = told(x["at"])
        value = F.when(before.rlike("://[^/ ]*:$") & x["word"].contains("@"), F.regexp_extract(x["word"], "^(.*)@", 1)).otherwise(x["word"])
        return F.struct(x["at"].cast("long").alias("at"), value.alias("value"), before.alias("before"), F.left(near(x["at"], 1), F.lit(NEIGHBOUR)).alias("after"))

    words = F.filter(F.transform("pieces", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: F.length(x["word"]) >= SHORTEST_NAMED)
    values = F.transform(F.filter(words, likely), found)
    return rows.select("doc_id", "path", F.explode(values).alias("f")).select("doc_id", "path", "f.*")


def labelled_findings(spark: SparkSession, n: int = MOST_LABELLED) -> DataFrame:
    """``n`` findings labelled by how they are made: keys, tokens and passwords, or digests, identifiers, paths and fillers."""
    i = F.col("id")
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), i.cast("string")), 512)
    pick = lambda salt, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(xs))) + 1).cast("int"))
    word = lambda salt: pick(salt, *WORDS)
    mixed_text = F.translate(F.base64(F.unhex(digest("b"))), "+/=", "xyz")
    size = F.pmod(F.xxhash64(F.lit("size"), i), F.lit(28)) + 20
    name = F.concat(pick("n", "token", "api_key", "secret", "password", "client_secret", "auth_token", "access_key", "private_key"), pick("s", " =", ":", " :", "="))
    prose = F.concat_ws(" ", word("p1"), word("p2"))
    number = F.pmod(F.xxhash64(F.lit("number"), i), F.lit(9999)).cast("string")
    leet = [F.translate(F.initcap(word("pw")), a, b) for a, b in (("aeo", "430"), ("os", "05"), ("ei", "31"), ("", ""))]
    spelled = F.element_at(F.array(*leet), (F.pmod(F.xxhash64(F.lit("leet"), i), F.lit(len(leet))) + 1).cast("int"))
    kinds = [
        (F.substring(digest("a"), 1, 40), name, 1),
        (F.substring(mixed_text, F.lit(1), size.cast("int")), name, 1),
        (F.concat(pick("pre", "AKIA", "ghp_", "sk-live-", "xoxb-"), F.substring(mixed_text, 1, 32)), prose, 1),
        (F.substring(digest("c"), 1, 64), name, 1),
        (F.substring(mixed_text, F.lit(1), size.cast("int")), F.lit("authorization: bearer"), 1),
        (F.concat(spelled, number, pick("mark", "!", "@", "#", "", "$9")), name, 1),
        (F.translate(F.substring(mixed_text, F.lit(1), (size - 8).cast("int")), "0123456789", "qwzjkvxhyp"), name, 1),
        (F.substring(F.concat(mixed_text, F.base64(F.unhex(digest("f")))), 1, 64), F.concat(pick("pem", "PRIVATE KEY-----", "KEY-----", ""), F.lit(" "), F.substring(F.base64(F.unhex(digest("g"))), 1, 64)), 1),
        (F.concat(F.substring(mixed_text, 3, 9), number), F.concat(pick("scheme", "postgres", "mysql", "amqp"), F.lit("://"), word("user"), F.lit(":")), 1),
        (F.substring(digest("d"), 1, 40), pick("g", "commit", "tree", "revision commit", "sha1:", "checksum ="), 0),
        (F.substring(digest("e"), 1, 64), pick("h", "sha256:", "digest =", "etag:", "checksum:"), 0),
        (F.concat_ws("_", word("w1"), word("w2"), word("w3"), word("w4"), F.pmod(i, F.lit(97)).cast("string")), name, 0),
        (F.concat_ws("/", word("w1"), word("w2"), word("w3"), F.concat(word("w4"), F.pmod(i, F.lit(9)).cast("string"), F.lit(".html"))), prose, 0),
        (F.concat_ws("-", F.substring(digest("u"), 1, 8), F.substring(digest("u"), 9, 4), F.substring(digest("u"), 13, 4), F.substring(digest("u"), 17, 4), F.substring(digest("u"), 21, 12)), pick("v", "uuid:", "request", "see version", "id"), 0),
        (F.concat(pick("f", "example", "your_token_here_", "changeme", "xxxxxxxxxxxx", "placeholder"), F.lit("_"), F.repeat(pick("g2", "x", "0", "1234"), 4)), name, 0),
        (F.concat(word("w5"), F.initcap(word("w6")), F.initcap(word("w7")), F.initcap(word("w8")), F.pmod(i, F.lit(31)).cast("string")), prose, 0),
        (F.concat(word("w9"), pick("sep", "-", "_", ".", ""), word("wa")), name, 0),
        (pick("none", "required", "string", "optional", "disabled", "undefined", "function", "********", "xxxxxxxx", "changeme"), name, 0),
    ]
    kind = F.pmod(i, F.lit(len(kinds)))
    chosen = lambda part: F.coalesce(*(F.when(kind == k, x[part] if isinstance(x[part], Column) else F.lit(x[part])) for k, x in enumerate(kinds)))
    return spark.range(n, numPartitions=1).select(chosen(0).alias("value"), chosen(1).alias("before"), word("after").alias("after"), pick("path", "src", "app", "test/fixtures", "docs/example.md", "").alias("path"), chosen(2).cast("double").alias("label"))


def fitted(findings: DataFrame, most: int = MOST_LABELLED) -> PipelineModel:
    """The forest, fitted on at most ``most`` labelled findings, chosen by hash: value, before, after, path and label (0 or 1)."""
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=TREE_DEPTH, seed=SEED)
    chosen = findings.orderBy(F.xxhash64("value", "before", "after", "path", "label")).limit(most)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(described(chosen))


def scanned(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """All candidates with ``score``, the forest's probability that they are secrets, and ``is_secret``."""
    told = fitted(findings).transform(described(candidates(documents)))
    return told.withColumn("score", vector_to_array("probability")[1]).withColumn("is_secret", F.col("score") >= CUT).drop(*FEATURES, "features", "rawPrediction", "probability", "prediction")


def secret_report(documents: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """doc_id, at (piece number), value_sha256, n_chars, score and is_secret of each candidate.

    ``findings``: labelled ones of the caller's own; without any, those of ``labelled_findings``. An empty table, null texts
    and texts without candidates give no rows; repeated rows give theirs each; extra columns are ignored; a null source is an
    empty path; texts are scanned whole, however long.
    """
    found = scanned(documents.select("doc_id", "text", "source"), labelled_findings(documents.sparkSession) if findings is None else findings)
    return found.select("doc_id", "at", F.sha2("value", 256).alias("value_sha256"), F.length("value").cast("long").alias("n_chars"), F.round("score", 6).alias("score"), "is_secret")
