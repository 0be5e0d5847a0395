"""Secret scan with a random forest that removes false positives.

Patterns propose candidates; features of each (length, changes between character classes, dictionary coverage, path,
neighbouring words) go to a random forest trained on labelled findings. Candidates come from every whole text; only the
training sample is bounded. Each row is scanned where it is read, copies too: no text is shuffled, and a hot group of
copies stays spread over the tasks. DataFrame functions and Spark's own forest alone: no Python in the tasks.

Labelled findings: those that people have judged (given by the caller), those made by a generator that knows what it
made, and those of the corpus whose value alone is certain (a published format, plain words, a path or a ruler of
signs). The context of a value (key names, assignments, hash words, path) never makes a label, so what it is worth is
learnt. held_out_quality measures precision and recall on findings that the forest did not see.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, dropped, let, stored, table, words

#: Labelled findings at most for the forest, and findings made by a rule.
TRAIN_ROWS, SYNTHETIC_ROWS = 20_000, 6_000
#: The least part of all letter triples of the corpus with which a triple is in the dictionary; ten and a hundred times
#: that part make it better known.
TRIPLE_SHARE = 1e-6
#: Published prefixes of credentials, key names, words next to hashes and words of placeholders.
KNOWN = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[0-9A-Za-z]{36}$|^xox[abprs]-[0-9A-Za-z-]{10,}$|^sk_live_[0-9A-Za-z]{16,}$|^AIza[0-9A-Za-z_-]{35}$|^eyJ[0-9A-Za-z_-]+\.eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+$|^-----BEGIN "
#: A private key block, which is one candidate.
PEM = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
KEY_NAME = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)"
HASH_WORD = r"(?i)^(commit|sha\d*|md5|checksum|hash|digest|etag|uuid|guid|revision|integrity)[:=]?$"
PLACEHOLDER = r"(?i)(example|sample|changeme|your[_-]|xxxx|0000|1234|dummy|placeholder|redacted|test)"
SAFE_PATH, RISKY_PATH = r"(?i)(test|example|sample|fixture|docs?/|mock)", r"(?i)(config|\.env|secret|credential|deploy|settings|\.pem|\.key)"
#: A candidate is a run of 16 or more of these signs with a digit, or of 20 or more, a known format anywhere in a word,
#: or what a key name is set to: up to the closing quote or, without one, to a blank, quote, comma, semicolon or the
#: next parameter of a query; or, where a key name is among the last 200 signs before a word and set, that word. A word
#: may hold many. The password in a URL's user information or after the user of a
#: command's user option, and what follows Authorization and its scheme, count as set by a key name.
SIGN = r"A-Za-z0-9+/_=.\-"
LONG = rf"[{SIGN}]{{16,}}"
ANYWHERE = r"(?<![A-Z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Z0-9])|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]+\.eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+"
QUOTED = r"(?<=\")(?:(?!\\?\")\S){8,}|(?<=')(?:(?!\\?')\S){8,}"
#: What stands in user information before its colon, and user information whose password (up to the last @ of the host
#: part) is a candidate.
USER_OF_URL = r"://[^\s/:@?&#=\"'<>]{0,200}"
URL_USER = USER_OF_URL + r":([^\s/\"'<>]{8,})@"
#: A user option, alone or with its value, the user and password after it, and a header's name and scheme.
USER_OPTION = r"^\W*(?:-u|-U|--user|--proxy-user)$"
USER_GLUED = r"^\W*(?:-u|-U|--user=|--proxy-user=)[\"']?[^\s:\"'/=]+:(?!//)([^\s\"']{8,})"
USER_VALUE = r"^[\"']?[^\s:\"'/=]+:(?!//)([^\s\"']{8,})"
SCHEME = r"(?i)(bearer|basic|digest|token|apikey)$"
AUTH_SCHEME = r"(?i)authorization\W{0,8}[=:]\W{0,8}(bearer|basic|digest|token|apikey)$"
ASSIGNED = KEY_NAME + rf"(?!(?<={USER_OF_URL}):)" + r"(?:\\?[\"'])?[=:](?:\\?[\"'])?(" + QUOTED + r"|(?<![\"'])(?:(?!\\?[\"']|&(?:amp;)?[\w.-]+=)[^\s,;]){8,})"
BLANK = r"\x20\x09-\x0D"
EDGES = "\"'`,;:()[]{}<>."
FEATURES = ("length", "transitions", "distinct", "digits", "upper", "hex", "coverage", "named", "assigned", "hash_near", "placeholder", "safe_path", "risky_path", "slashes")


def promising(docs: DataFrame) -> DataFrame:
    """The rows of docs that can hold a candidate."""
    t = F.col("text")
    return docs.where(t.rlike(LONG) | t.rlike(KEY_NAME + rf"[^{BLANK}]{{0,200}}(?:[{BLANK}]++[^{BLANK}]{{0,200}})?[=:]") | t.rlike(URL_USER) | t.rlike(rf"(?:^|[{BLANK}])\W{{0,3}}-(?:[uU]|-user|-proxy-user)|(?i:authorization\W{{0,8}}[=:])") | t.contains("-----BEGIN "))


def _units(text: Column) -> Column:
    """The words of a text, each private key block being one."""
    parts, blocks = F.split(text, PEM, -1), F.regexp_extract_all(text, F.lit(PEM), F.lit(0))
    mixed = F.flatten(F.zip_with(parts, blocks, lambda a, b: F.concat(words(a), F.when(b.isNotNull(), F.array(b)).otherwise(F.array().cast("array<string>")))))
    return F.when(text.contains("-----BEGIN "), mixed).otherwise(words(text))


def candidates(docs: DataFrame) -> DataFrame:
    """(row_key, path, value, before, name, set): one row per candidate. docs: row_key, path, text."""
    w = promising(docs).select("row_key", "path", _units(F.col("text")).alias("w"))
    some = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (F.length(F.get("w", i)) >= 8) & let(F.get("w", i), lambda x: x.rlike(LONG) | x.rlike(KEY_NAME) | x.rlike(URL_USER) | x.rlike(USER_GLUED) | x.startswith("-----BEGIN ") | let(F.get("w", i - 1), lambda b: b.rlike(r"[=:]\W{0,8}$") | (b.rlike(USER_OPTION) & x.contains(":")) | (b.rlike(SCHEME) & F.concat_ws(" ", F.get("w", i - 2), b).rlike(AUTH_SCHEME)))))
    at = w.where(F.size("w") > 0).select("row_key", "path", "w", F.explode(some).alias("i"))
    word = F.get("w", F.col("i"))
    near = at.select("row_key", "path", word.alias("word"), F.coalesce(F.get("w", F.col("i") - 1), F.lit("")).alias("b1"), F.coalesce(F.get("w", F.col("i") - 2), F.lit("")).alias("b2"))
    by_scheme = F.concat_ws(" ", "b2", "b1").rlike(AUTH_SCHEME)
    before = F.when(F.col("b1").rlike(r"^\W*[=:]\W*$") | by_scheme, F.concat_ws(" ", "b2", "b1")).otherwise(F.col("b1"))
    near = near.select("row_key", "path", "word", F.btrim("word", F.lit(EDGES)).alias("bare"), before.alias("before"), F.regexp_extract(F.right(before, F.lit(200)), KEY_NAME, 0).alias("near_name"), (before.rlike(r"[=:]\W{0,8}$") | by_scheme).alias("near_set"))
    # passwords of users: in URLs, and after a user option that is the word before or the word's own start
    option = F.rtrim(F.when(F.col("before").rlike(USER_OPTION), F.regexp_extract("word", USER_VALUE, 1)).otherwise(F.regexp_extract("word", USER_GLUED, 1)), F.lit("`,;"))
    near = near.withColumns({"in_urls": F.regexp_extract_all("word", F.lit(URL_USER), F.lit(1)), "option": option})
    users = F.concat("in_urls", F.filter(F.array("option"), lambda v: v != ""))
    # the word as a whole where the word before sets a key name: what its first quotes hold, else all of it
    quoted = F.regexp_extract("word", rf"^[(\[{{]*\\?[\"']({QUOTED})", 1)
    set_before = (F.col("near_name") != "") & F.col("near_set")
    near = near.withColumns({"quoted": F.when(set_before, quoted).otherwise(""), "whole": F.when(set_before & (quoted == ""), F.col("bare")).otherwise(""), "names": F.regexp_extract_all("word", F.lit(ASSIGNED), F.lit(1)), "values": F.regexp_extract_all("word", F.lit(ASSIGNED), F.lit(3))})
    plain = F.col("whole").rlike(r"^[^\"',;{}]+$")  # nothing but the one value
    left = F.when(F.col("quoted") != "", F.replace("word", F.col("quoted"), F.lit(" "))).otherwise(F.col("bare"))
    left = F.regexp_replace(left, rf"({USER_OF_URL}:)[^\s/\"'<>]{{8,}}@", "$1 @")
    left = F.when(F.col("option") != "", F.replace(left, F.col("option"), F.lit(" "))).otherwise(left)
    near = near.withColumns({"rest": F.when(plain, "").otherwise(F.regexp_replace(left, ASSIGNED, " ")), "inside": F.concat("values", F.array(F.col("quoted"), F.when(plain, F.col("whole")).otherwise("")))})
    known = lambda text: F.regexp_extract_all(text, F.lit(ANYWHERE), F.lit(0))
    nested = F.flatten(F.transform("inside", lambda v: F.filter(known(v), lambda k: k != v)))
    runs = F.transform(F.regexp_extract_all(F.regexp_replace("rest", ANYWHERE, " "), F.lit(LONG), F.lit(0)), lambda v: F.btrim(v, F.lit(".")))
    item = lambda value, name, set_: F.struct(value.alias("value"), name.alias("name"), set_.alias("set"))
    by_near = lambda v: item(v, F.col("near_name"), F.col("near_set"))
    each = F.concat(F.transform(users, lambda v: item(v, F.lit("password"), F.lit(True))), F.zip_with("values", "names", lambda v, k: item(v, k, F.lit(True))), F.transform(F.concat(F.filter(F.array("quoted", "whole"), lambda v: v != ""), known(F.col("rest")), nested, runs), by_near))
    each = F.when(F.col("word").rlike(r"^-----BEGIN [\s\S]*-----$"), F.array(item(F.col("word"), F.lit("private key"), F.lit(True)))).otherwise(each)
    found = near.select("row_key", "path", "before", F.explode(each).alias("c")).select("row_key", "path", "c.value", "before", "c.name", "c.set")
    return found.where((F.length("value") >= 20) | ((F.length("value") >= 16) & F.col("value").rlike(r"\d")) | F.col("value").rlike(KNOWN) | ((F.col("name") != "") & F.col("set") & (F.length("value") >= 8)))


def _share(value: Column, pattern: str) -> Column:
    return (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))) / F.length(value)


def _triples(text: Column) -> Column:
    """The distinct runs of three letters of a text, lower-cased."""
    t = F.lower(text)
    return F.array_distinct(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substr(t, i, F.lit(3))), lambda x: x.rlike("^[a-z]{3}$")))


def dictionary(docs: DataFrame, share: float = TRIPLE_SHARE) -> DataFrame:
    """(triple, level): letter triples, at most 26^3, that make a share of all triples in the words of docs (level 1), ten
    times (2) or a hundred times that share (3). Words are counted first."""
    w = docs.select(F.explode(words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("w").rlike(r"^\p{L}{3,14}\W?$"))
    per = w.select(F.explode(_triples(F.col("w"))).alias("triple"), "n").groupBy("triple").agg(F.sum("n").alias("n"))
    part = per.join(F.broadcast(per.agg(F.sum("n").alias("total"))), F.lit(True)).withColumn("part", F.col("n") / F.col("total"))
    return part.where(F.col("part") >= share).select("triple", (1 + (F.col("part") >= 10 * share).cast("int") + (F.col("part") >= 100 * share).cast("int")).alias("level"))


def levels_of(triples: DataFrame) -> bytes:
    """The level of every one of the 26^3 triples as a byte, 0 where the dictionary lacks it."""
    out = bytearray(26**3)
    for r in triples.collect():  # at most 26^3 rows
        a, b, c = (ord(x) - 97 for x in r.triple)
        out[676 * a + 26 * b + c] = r.level
    return bytes(out)


def features(found: DataFrame, levels: bytes) -> DataFrame:
    """found with FEATURES. Coverage is how well the dictionary knows a value's letter triples on average, times the share
    of letters. Each candidate is worked out in its own row."""
    v = F.col("value")
    kind = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[A-Z]", "\u0001"), "[a-z]", "\u0002"), "[0-9]", "\u0003")
    letter = lambda t, k: F.ascii(F.substr(t, F.lit(k), F.lit(1))) - 97
    level = lambda t: F.ascii(F.substr(F.lit(levels), 676 * letter(t, 1) + 26 * letter(t, 2) + letter(t, 3) + 1, F.lit(1)).cast("string"))
    known = let(_triples(v), lambda t: F.aggregate(t, F.lit(0), lambda a, x: a + level(x)) / F.greatest(3 * F.size(t), F.lit(1)))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return found.withColumns({
        "length": F.length(v).cast("double"), "transitions": (F.length(F.regexp_replace(kind, r"(.)\1+", "$1")) - 1) / F.length(v), "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.length(v),
        "digits": _share(v, "[0-9]"), "upper": _share(v, "[A-Z]"), "hex": flag(v.rlike("^[0-9a-fA-F]+$")), "coverage": known * _share(v, "[A-Za-z]"),
        "named": flag(F.col("name") != ""), "assigned": flag(F.col("set")), "hash_near": flag(F.element_at(F.split("before", " "), 1).rlike(HASH_WORD)), "placeholder": flag(v.rlike(PLACEHOLDER)),
        "safe_path": flag(F.col("path").rlike(SAFE_PATH)), "risky_path": flag(F.col("path").rlike(RISKY_PATH)), "slashes": _share(v, "[/.]"),
    })


def labelled(found: DataFrame) -> DataFrame:
    """Findings with a `label` that their value alone makes certain: published formats are secrets (1); plain words,
    paths and rulers of one sign are not (0). Others have no label and are left out."""
    v = F.col("value")
    not_secret = v.rlike(r"^\p{L}+$") | v.rlike(r"^(\.?/[a-z_.-]+){2,}$") | v.rlike(r"^(.)\1{7,}$")
    return found.withColumn("label", F.when(not_secret, 0.0).when(v.rlike(KNOWN), 1.0)).where(F.col("label").isNotNull())


def synthetic(spark: SparkSession, n: int = SYNTHETIC_ROWS) -> DataFrame:
    """(value, before, name, set, path, label): findings of which the generator knows what they are. Kind, length, place
    and neighbours are drawn from hashes of the row number."""
    bits = lambda part: F.sha2(F.concat(F.col("id").cast("string"), F.lit(part)), 256)
    number = lambda part, below: F.pmod(F.xxhash64(F.lit(part), "id"), F.lit(below)).cast("int")
    one_of = lambda part, options: F.get(F.array(*(F.lit(x) for x in options)), number(part, len(options)))
    long = F.concat(bits("a"), bits("b"))
    b64 = F.regexp_replace(F.base64(F.unhex(long)), r"[\r\n=]", "")
    upto = lambda text, low, high: F.substr(text, F.lit(1), low + number("length", high - low + 1))
    upper = lambda k: F.translate(F.upper(F.substr(bits("c"), F.lit(1), F.lit(k))), "0123456789", "GHJKMNPQ23")
    syllables = F.array(*(F.lit(x) for x in ("ber", "kon", "ti", "sel", "mar", "lo", "ven", "da", "rin", "ost", "pel", "u", "gra", "fin", "que", "sta")))
    word = lambda part, k: F.array_join(F.transform(F.split(F.substr(bits(part), F.lit(1), F.lit(k)), ""), lambda c: F.get(syllables, F.conv(c, 16, 10).cast("int"))), "")
    title = lambda part, k: F.initcap(word(part, k))
    digits = lambda k: F.translate(F.substr(bits("d"), F.lit(1), F.lit(k)), "abcdef", "012345")
    uuid = F.regexp_replace(F.substr(long, F.lit(1), F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    secret_name, plain = ("password", "token", "secret", "api_key", "private_key"), ("the", "with", "see", "and", "from", "value")
    set_, bare = (F.concat(one_of("key", secret_name), F.lit(" =")), one_of("key", secret_name), True), (one_of("near", plain), F.lit(""), False)
    said = (one_of("key", secret_name), one_of("key", secret_name), False)
    hashed = (one_of("hash", ("commit", "sha256:", "md5", "checksum", "digest", "revision")), F.lit(""), False)
    rows = [
        (F.concat(F.lit("AKIA"), upper(16)), bare, 1), (F.concat(F.lit("ASIA"), upper(16)), set_, 1), (F.concat(F.lit("ghp_"), F.substr(F.regexp_replace(b64, "[+/]", "x"), F.lit(1), F.lit(36))), bare, 1), (upto(long, 18, 64), set_, 1), (upto(long, 18, 40), set_, 1), (F.upper(upto(long, 18, 48)), set_, 1), (upto(b64, 20, 64), set_, 1),
        (upto(b64, 24, 48), said, 1), (F.concat(title("e", 2), digits(2), F.lit("!"), word("f", 2), digits(3)), set_, 1), (F.concat(word("e", 3), digits(4)), set_, 1), (F.concat(title("e", 1), F.lit("$"), upto(b64, 8, 14)), set_, 1), (F.concat(word("e", 2), digits(1), word("f", 2)), set_, 1), (upto(long, 32, 64), said, 1),
        (word("e", 9), bare, 0), (word("e", 5), set_, 0), (title("e", 8), said, 0), (upto(long, 32, 64), hashed, 0), (F.substr(long, F.lit(1), F.lit(40)), hashed, 0), (uuid, bare, 0), (uuid, hashed, 0), (F.concat(F.lit("your-"), word("e", 4)), set_, 0), (F.concat(F.lit("EXAMPLE"), upto(long, 8, 24)), set_, 0), (F.concat(F.lit("changeme"), digits(4)), set_, 0),
        (F.concat_ws("/", word("e", 3), word("f", 4), word("g", 2)), bare, 0), (F.concat(F.lit("/"), word("e", 3), F.lit("/"), word("f", 5)), set_, 0), (F.concat_ws("_", word("e", 3), word("f", 3), word("g", 2)), bare, 0), (F.concat(word("e", 3), title("f", 4), title("g", 3)), bare, 0), (F.concat_ws(".", word("e", 2), word("f", 4), word("g", 4)), bare, 0), (F.concat_ws("-", word("e", 3), word("f", 3), word("g", 4)), said, 0),
        (digits(20), bare, 0), (F.concat(F.lit("2024-0"), digits(1), F.lit("-1"), digits(1), F.lit("T10."), digits(9)), bare, 0), (F.repeat(one_of("sign", ("=", "-", "_", ".", "a", "0")), 16 + number("length", 40)), bare, 0), (F.concat(word("e", 4), F.lit("."), word("f", 2), F.lit("."), digits(2)), bare, 0),
    ]
    path = one_of("path", ("", "", "src", "web", "deploy/config.yml", ".env", "docs/log", "tests/sample", "settings.py"))
    item = [F.struct(v.alias("value"), c[0].alias("before"), c[1].alias("name"), F.lit(c[2]).alias("set"), path.alias("path"), F.lit(float(label)).alias("label")) for v, c, label in rows]
    return spark.range(n).select(F.get(F.array(*item), F.pmod("id", F.lit(len(rows))).cast("int")).alias("r")).select("r.*")


def forest(train: DataFrame, seed: int = 7):
    """The forest's model over an assembled vector of FEATURES."""
    return RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=24, maxDepth=6, maxBins=32, seed=seed).fit(assembled(train))


def assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(df)


def _training(feats: DataFrame, levels: bytes, extra_labels: DataFrame | None, train_rows: int) -> DataFrame:
    """Rows with FEATURES, label and value: one for each value of the corpus whose label is certain (its least one, and
    at most train_rows of them by their hash), all made ones and all judged ones."""
    spark = feats.sparkSession
    made = features(synthetic(spark) if extra_labels is None else synthetic(spark).unionByName(extra_labels), levels)
    own = labelled(feats).groupBy("value").agg(F.min(F.struct("label", *FEATURES)).alias("f")).orderBy(F.xxhash64("value"), "value").limit(train_rows)
    return own.select("f.*", "value").unionByName(made.select("label", *FEATURES, "value"))


def held_out_quality(labels: DataFrame, levels: bytes, part: int = 4) -> tuple[float, float]:
    """Precision and recall on a part of labelled findings (value, before, name, set, path, label), dealt by value, of a
    forest trained on the rest."""
    feats = stored(features(labels, levels), "labelled")
    fold = F.pmod(F.xxhash64("value"), F.lit(part)) == 0
    got = forest(feats.where(~fold)).transform(assembled(feats.where(fold)))
    hit = got.agg(F.sum(F.when((F.col("label") == 1) & (F.col("prediction") == 1), 1).otherwise(0)), F.sum(F.col("prediction")), F.sum("label")).first()
    return hit[0] / (hit[1] or 1), hit[0] / (hit[2] or 1)


def scored(docs: DataFrame, extra_labels: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(row_key, value, before, name, path, is_secret) for every candidate of each row, row_key being a struct of the row's
    key and its place, which tells copies apart. docs: row_key, path, text. extra_labels: findings (value, before, name,
    set, path, label) that people have judged, added to the training."""
    levels = levels_of(dictionary(docs))
    placed = docs.withColumn("row_key", F.struct(F.col("row_key").alias("key"), F.monotonically_increasing_id().alias("place")))
    feats = stored(features(candidates(placed), levels), "features")
    train = stored(_training(feats, levels, extra_labels, train_rows).drop("value"), "findings")
    model = forest(train)
    dropped(train)
    return model.transform(assembled(feats)).select("row_key", "value", "before", "name", "path", (F.col("prediction") == 1).alias("is_secret"))


def row_key(docs: DataFrame, text_col: str, path_col: str) -> Column:
    """128 bits that stand for a row's path and text."""
    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit("")
    return F.unhex(F.md5(F.concat(F.coalesce(path, F.lit("")), F.lit("\u0000"), F.coalesce(F.col(text_col), F.lit("")))))


def _rows(docs: DataFrame, text_col: str, path_col: str) -> DataFrame:
    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit("")
    return docs.select(row_key(docs, text_col, path_col).alias("row_key"), F.coalesce(path, F.lit("")).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, n_candidates, n_secrets (both counted as often as they stand in the text) and secrets (the distinct values,
    sorted) of each row of docs.

    Equal rows (of one path and text, matched by a 128-bit hash) each get the full result of one, as do rows with null
    ids. A null or empty text has no candidates; a missing path column counts as an empty path; an
    empty table gives an empty result; other columns are ignored. A value is a secret of a row if any place of it is.
    """
    found = scored(_rows(docs, text_col, path_col))
    values = found.groupBy("row_key", "value").agg(F.count("*").alias("n"), F.max("is_secret").alias("is_secret"), F.sum(F.col("is_secret").cast("int")).alias("s"))
    each = values.groupBy("row_key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sort_array(F.collect_list(F.when(F.col("is_secret"), F.col("value")))).alias("secrets"))
    one = each.groupBy(F.col("row_key.key").alias("row_key")).agg(F.min(F.struct("n", "s", "secrets")).alias("r"))  # copies have equal ones
    per = stored(one.select("row_key", "r.*"), "secrets")
    keyed = docs.select(F.col(id_col).alias("doc_id"), row_key(docs, text_col, path_col).alias("row_key"))
    return keyed.join(per, "row_key", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_candidates"), F.coalesce("s", F.lit(0)).cast("bigint").alias("n_secrets"), F.coalesce("secrets", F.array().cast("array<string>")).alias("secrets"))


def without_secrets(docs: DataFrame, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """The rows of docs in which no secret is found, with the columns of docs; rules as in scan."""
    bad = stored(scored(_rows(docs, text_col, path_col)).where("is_secret").select(F.col("row_key.key").alias("row_key")).distinct(), "secrets")
    few = bad.count() <= BROADCAST_IDS
    key = bad.select(F.col("row_key").alias("_secret_row_key"))
    return docs.join(F.broadcast(key) if few else key, row_key(docs, text_col, path_col) == F.col("_secret_row_key"), "left_anti")


def op8_secret_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
