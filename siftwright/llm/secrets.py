"""Secret scanning with a random forest that removes false positives, in DataFrame operations alone.

A pattern proposes candidates: whole runs, eight characters or more, of letters, digits and a few marks (+ / . _ -)
without the points at their end, that hold a digit, a capital after a small letter, 24 characters or more, a known
prefix, or stand behind a word such as `password`. Behind such a word and a sign, what stands there up to a blank, a
quote or a bracket is a candidate whatever marks it has. What is no secret among them is the forest's to reject; a plain
word of one case without any of these marks cannot be told from prose and is none. Each candidate is described by its
length, the transitions between its characters' classes, how much of it dictionary words cover, its likeness to a
path, and the words and marks beside it; a forest trained on labelled findings decides. The trained trees become
nested CASE expressions over these features, so scoring runs inside the query plan.

The text is split at the pattern, so a candidate's place is where it matched; running sums of the parts' lengths give
offsets, in blocks, so that the work stays near linear in the number of candidates of a text.

`example_findings` makes labelled findings from rules: kinds of credentials in the places where they stand, and kinds
of text that only look like them (addresses, hashes of commits, versions, identifiers, numbers, paths, placeholders).
Any table of (before, candidate, after, label) can replace it.

Defined cases: null and empty texts have no candidates; a candidate is taken whole, however long it is; rows that repeat are scanned each; null ids stay null; ties of a tree's split go to the left branch.
"""

from __future__ import annotations

import zlib

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm.common import stage_table

RUN = "[A-Za-z0-9_+/.-]"
#: A run behind a secret's name and a sign, with any marks: up to a blank, a quote or what closes a list.
SAID = r"[^\s\"'`<>(){}\[\],;]"
PREFIX = "[+/._-]*(?:AKIA|ASIA|AIza|gh[pousr]_|glpat-|xox[abprs]-|sk_|pk_|rk_|sk-|eyJ|SG\\.)"
#: Words that secrets follow. Fixed values.
NAMES = "tokens?|secrets?|passw(?:or)?ds?|passphrase|pwd|pass|credentials?|api.?key|access.?key|private.?key|auth[a-z]{0,13}|bearer"
BEHIND = rf"(?<=(?i:{NAMES})[^A-Za-z0-9]{{1,6}})"
#: Behind `name=` or `name: ` whatever stands there but for a last dot, if it has a mark that other runs lack; else a run.
#: The first two tests are cheap and fail nearly everywhere; only behind a sign is the name looked for.
MARKED = rf"(?<=[:=>\s\"'`])(?<=[:=>]\s{{0,2}}[\"'`]?)(?={SAID}{{8}})(?<=(?i:{NAMES})[\"']?\s{{0,2}}(?::=|=>|[:=])\s{{0,2}}[\"'`]?)(?={SAID}{{0,200}}[!#$%&*?@^~|\\]){SAID}{{8,}}(?<!\.)"
CANDIDATE = rf"(?:{MARKED})|(?:(?<!{RUN})(?={RUN}{{8}})(?:(?={RUN}*[0-9])|(?={RUN}*[a-z][A-Z])|(?={RUN}{{24}})|(?={PREFIX})|{BEHIND}){RUN}{{7,}}[A-Za-z0-9_+/-]={{0,2}})"
#: Parts of which running sums are taken at once.
BLOCK = 256
#: Columns of random numbers that the examples are made of.
DRAWS = 32
BEFORE = 32
THRESHOLD = 0.5
MASK = "[SECRET]"

#: Words that count as dictionary words inside a candidate. Fixed values.
DICTIONARY = (
    "about address admin after alpha also api application archive back base beta book build cache change changeme chapter check class client code color com common config "
    "content count data date default demo dev doc docs document dummy east edit error event example file final first font form from github google group guide have help home "
    "host http https image index info input internal item json key lang level lib line link linux list local log mail main manual master media message model module "
    "name net network node note number object office online order org output page part password path phone photo placeholder port post print product project public read "
    "release report request response result root sample script search section secret server service session setting site size source src start state static status style "
    "system table task temp template test text that the this time title token tool type update upload user util utils value version video view web week west windows with word "
    "work world www year your"
).split()
#: Any of them, the longest first, grouped by first letter.
COVER = "(?i)(?:" + "|".join(c + "(?:" + "|".join(w[1:] for w in sorted(DICTIONARY, key=lambda w: (-len(w), w)) if w[0] == c) + ")" for c in sorted({w[0] for w in DICTIONARY})) + ")"
SECRET_WORDS = rf"(?i)({NAMES})\W{{0,6}}$"
OTHER_WORDS = r"(?i)(commit|revision|sha-?\d*|md5|checksum|digest|hash|etag|uuid|guid|id|version|release|build|phone|tel|fax|isbn|order|ip|host|file|page|path|see|on|at)\W{0,3}$"
PREFIXES = "^" + PREFIX
FEATURES = ("length", "transitions", "digit_share", "upper_share", "symbol_share", "vowel_share", "different_share", "covered", "is_hex", "is_digits_marks", "segments", "short_segments", "ends_like_name", "prefix", "secret_word", "other_word", "assigned", "quoted")


def describe(candidate: Column, before: Column, after: Column) -> Column:
    """Struct of the features of a candidate between two pieces of text."""
    n = F.length(candidate)
    left = lambda pattern: F.length(F.regexp_replace(candidate, pattern, ""))
    share = lambda pattern: (n - left(pattern)) / n
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(candidate, "[a-z]+", "l"), "[A-Z]+", "U"), "[0-9]+", "d"), "[^lUd]+", "s")
    yes = lambda c: c.cast("double")
    values = {
        "length": n,
        "transitions": (F.length(shape) - 1) / n,
        "digit_share": share("[0-9]"),
        "upper_share": share("[A-Z]"),
        "symbol_share": share("[^A-Za-z0-9]"),
        "vowel_share": share("[aeiouAEIOU]"),
        "different_share": F.size(F.array_distinct(F.split(candidate, ""))) / F.least(n, F.lit(64)),  # longer ones repeat their letters
        "covered": share(COVER),
        "is_hex": yes(candidate.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "is_digits_marks": yes(candidate.rlike("^[0-9./_+-]+$")),
        "segments": F.size(F.split(candidate, "[./_-]")),
        "short_segments": n / F.size(F.split(candidate, "[./_-]")),
        "ends_like_name": yes(candidate.rlike(r"\.[A-Za-z]{2,5}$")),
        "prefix": yes(candidate.rlike(PREFIXES)),
        "secret_word": yes(before.rlike(SECRET_WORDS)),
        "other_word": yes(before.rlike(OTHER_WORDS)),
        "assigned": yes(before.rlike(r"[=:]\s*[\"']?$")),
        "quoted": yes(before.rlike("[\"']$") & after.rlike("^[\"']")),
    }
    return F.struct(*[values[k].cast("double").alias(k) for k in FEATURES])


def example_findings(spark: SparkSession, rows: int = 6000, seed: int = 11) -> DataFrame:
    """Labelled findings (before, candidate, after, label), the same for the same seed."""
    # a row is of one kind, so all kinds draw from the same columns of random numbers
    slot = lambda salt: zlib.crc32(salt.encode()) % DRAWS
    bits = lambda salt: F.col(f"bits{slot(salt)}")
    pick = lambda salt, *of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.col(f"draw{slot(salt)}"), F.lit(len(of))) + 1).cast("int"))
    number = lambda salt, most: F.pmod(F.col(f"draw{slot(salt)}"), F.lit(most)).cast("string")
    b64 = lambda salt: F.translate(F.base64(F.unhex(bits(salt))), "\n", "")
    plain = lambda salt, n: F.substring(F.translate(F.concat(b64(salt), b64(salt + "x")), "+/=", ""), 1, n)
    hexa = lambda salt, n: F.substring(F.concat(bits(salt), bits(salt + "x")), 1, n)
    long = lambda salt: F.translate(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4) + F.pmod("id", F.lit(40))), lambda i: F.base64(F.unhex(F.sha2(F.concat_ws("|", bits(salt), i), 256)))), ""), "\n=", "")
    word = lambda salt: pick(salt, "river", "hand", "ciudad", "maison", "Haus", "over", "then", "onth", "ering", "monde", "zwischen", "table", "garden")
    syllable = lambda salt: pick(salt, "ba", "cen", "di", "fer", "gu", "hin", "ja", "kel", "lo", "men", "ni", "por", "qui", "ra", "schen", "ti", "un", "ver", "wa", "zu", "tion", "eau", "ing", "ent", "th", "sch", "bert", "wh", "ly", "nd")
    made_up = lambda salt: F.concat(*[syllable(f"{salt}{i}") for i in range(3)], F.when(F.pmod("id", F.lit(2)) == 0, syllable(salt + "x")).otherwise(""))
    phrase = lambda salt: F.concat(made_up(salt), F.initcap(word(salt + "y")), F.initcap(made_up(salt + "z")))
    prose = F.concat(word("w1"), F.lit(" "), word("w2"), F.lit(" "))
    key = lambda *names: F.concat(prose, pick("name", *names), pick("sign", " = \"", "=", ": ", "='", " := \"", "=\""))
    kinds: list[tuple[Column, Column, int]] = [
        (key("token", "access_token", "auth_token", "secret"), hexa("a", 40), 1),
        (key("password", "passwd", "db_password", "pwd"), hexa("b", 18), 1),
        (key("password", "secret", "admin_password"), plain("c", 14), 1),
        (key("password", "passwd", "token", "db_password"), F.concat(plain("ca", 4), pick("cam", "@", "!", "#", "$", "%", "&", "*"), plain("cb", 5), pick("can", "!", "$", "?", "^", "~", "@")), 1),
        (key("password", "passwd", "secret"), F.concat(made_up("cc"), pick("cdm", "@", "!", "&", "$"), number("cd", 9000)), 1),
        (prose, F.concat(F.lit("AKIA"), F.substring(F.upper(F.translate(plain("d", 40), "01", "")), 1, 16)), 1),
        (key("aws_access_key", "key"), F.concat(F.lit("AKIA"), F.substring(F.upper(plain("d2", 40)), 1, 16)), 1),
        (key("api_key", "apikey", "API_KEY", "client_secret"), plain("e", 32), 1),
        (F.concat(prose, F.lit("Authorization: Bearer ")), F.concat(F.lit("eyJ"), plain("f", 30), F.lit("."), plain("g", 40)), 1),
        (prose, F.concat(pick("gh", "ghp_", "gho_", "ghs_"), plain("h", 36)), 1),
        (prose, F.concat(pick("st", "sk_live_", "rk_live_", "sk-"), plain("i", 28)), 1),
        (key("secret", "secret_key", "private_key"), b64("j"), 1),
        (prose, plain("k", 40), 1),
        (key("token", "secret"), hexa("l", 32), 1),
        (key("token", "private_key", "secret"), long("la"), 1),
        (F.concat(prose, F.lit("Authorization: Bearer ")), F.concat(F.lit("eyJ"), plain("lb", 30), F.lit("."), long("lc"), F.lit("."), plain("ld", 40)), 1),
        (prose, F.repeat(pick("lrep", "1a", "xx0", "abc1", "00", "a1b2"), 300), 0),
        (key("password", "passwd", "pwd", "secret", "db_password"), phrase("pa"), 1),
        (key("password", "passwd", "pwd", "secret"), F.concat(made_up("pb"), pick("pbs", "", "-", "_", "."), made_up("pc")), 1),
        (key("secret", "secret_key", "token"), F.concat(pick("lead", "/", "+"), F.substring(b64("pd"), 2, 39)), 1),
        (F.concat(prose, F.lit("https:")), F.concat(pick("hook", "//hooks.slack.com/services/T", "//hooks.example.com/services/T", "//discord.com/api/webhooks/"), F.upper(plain("pe", 9)), F.lit("/B"), F.upper(plain("pf", 9)), F.lit("/"), plain("pg", 24)), 1),
        (F.concat(prose, pick("db", "mysql ", "mysql -u root ", "mysqldump -u admin ")), F.concat(F.lit("-p"), plain("ph2", 14)), 1),
        (prose, F.concat(F.lit("AKIA"), F.translate(F.upper(plain("pi", 60)).substr(1, 16), "0123456789", "QXZJKVWPYB")), 1),
        (prose, made_up("na"), 0),
        (prose, F.initcap(made_up("nb")), 0),
        (F.concat(prose, pick("nbq", "(", "\"", "'", "")), F.upper(made_up("nc")), 0),
        (F.concat(F.upper(prose), pick("ncm", "", "!! ", ". ")), F.upper(F.concat(made_up("ncu"), syllable("ncv"))), 0),
        (F.upper(prose), F.upper(F.concat(made_up("ncw"), made_up("ncx"))), 0),
        (prose, phrase("nd"), 0),
        (prose, F.concat_ws("-", word("ne"), made_up("nf"), word("ng")), 0),
        (prose, F.concat(made_up("nh"), pick("nhs", ".", "/", "_"), made_up("ni")), 0),
        (F.concat(prose, pick("njs", "secret ", "the password ", "token ", "authentic ", "credentials, ", "auth ")), F.concat(made_up("nj"), pick("njx", "", "-", "s")), 0),
        (F.concat(prose, pick("nks", "name = \"", "title: ", "class=\"", "lang=", "author: ")), made_up("nk"), 0),
        (key("token", "auth", "pass", "password", "secret"), F.concat(pick("mks", "https://", "http://"), pick("mkw", "www.", "docs.", ""), word("mk"), pick("mkt", ".com", ".org", ".fr"), F.lit("/"), made_up("ml"), pick("mkq", "?page=", "?q=", "?ref="), made_up("mm")), 0),
        (prose, F.repeat(pick("rule", "-", ".-", "_", "+-", "/", "--"), 9), 0),
        (prose, F.repeat(pick("rule2", "x", "ab", "ha", "A"), 200), 0),
        (F.concat(prose, pick("scheme", "https:", "http:", "")), F.concat(F.lit("//"), pick("sub", "www.", "docs.", ""), word("nl"), pick("tld3", ".com", ".org", ".fr", ".io"), F.lit("/"), made_up("nm"), pick("deep", "/", "/page/", "/2023/", "/v1/"), made_up("nn"), pick("nnx", "", ".html", "-12")), 0),
        (prose, F.concat_ws("/", F.lit(""), pick("np", "usr", "home", "var", "opt"), made_up("nq"), F.concat(word("nr"), number("nrn", 99)), F.concat(made_up("ns"), pick("nsx", "", ".py", ".so", ".log"))), 0),
        (prose, F.concat(F.lit("--"), word("nt"), F.lit("-"), made_up("nu")), 0),
        (prose, F.concat(pick("sign2", "-", "+", "..", "/"), number("nv", 99999999), pick("nvx", ".5", "-7", "/12"), number("nw", 9999)), 0),
        (prose, F.concat_ws(".", number("n1", 256), number("n2", 256), number("n3", 256), number("n4", 256)), 0),
        (F.concat(prose, pick("ipw", "host ", "ip ", "from ")), F.concat_ws(".", number("n1", 256), number("n2", 256), number("n3", 256), number("n4", 256)), 0),
        (F.concat(prose, F.lit("(")), F.concat_ws("-", number("n5", 900), number("n6", 900), number("n7", 9000)), 0),
        (F.concat(prose, word("at"), F.lit("@")), F.concat(pick("mail", "mail", "mx", "smtp", "host"), number("n8", 90), F.lit("."), pick("dom", "example", "company", "office", "uni"), pick("tld", ".com", ".org", ".net", ".de")), 0),
        (prose, F.concat(word("u"), F.lit("."), number("n9", 100)), 0),
        (prose, F.concat(F.lit("20"), number("n10", 90), F.lit("-0"), number("n11", 9), F.lit("-1"), number("n12", 9)), 0),
        (F.concat(prose, pick("uid", "id ", "uuid ", "id: ", "request ", "")), F.concat_ws("-", hexa("m", 8), hexa("n", 4), hexa("o", 4), hexa("p", 4), hexa("q", 12)), 0),
        (F.concat(prose, pick("com", "commit ", "revision ", "commit: ", "merge commit ")), hexa("r", 40), 0),
        (F.concat(prose, pick("sha", "sha256:", "sha256 ", "checksum: ", "digest ", "md5 ", "md5=", "etag: ")), hexa("s", 64), 0),
        (prose, F.concat_ws("/", pick("d1", "src", "docs", "lib", "static"), pick("d2", "main", "images", "v2", "util"), F.concat(word("f"), number("n13", 99), pick("ext", ".html", ".py", ".json", ".png"))), 0),
        (prose, F.concat(number("n14", 99999999), number("n15", 99999999), number("n16", 999)), 0),
        (prose, F.concat(word("v"), word("x"), number("n17", 9)), 0),
        (prose, F.concat(pick("rel", "release-", "version-", "build-", "v", "python-"), F.concat_ws(".", number("n18", 20), number("n19", 20), number("n20", 20)), pick("suffix", "", "-beta2", "-rc1", ".final")), 0),
        (key("password", "token", "secret", "api_key"), F.concat(pick("ph", "changeme", "example", "your-token-here-", "placeholder", "test_password_", "sample-secret-", "dummy_key_"), number("n21", 999)), 0),
        (prose, F.concat(F.lit("www."), word("site"), number("n22", 99), pick("tld2", ".com", ".org", ".fr"), F.lit("/page/"), number("n23", 999)), 0),
        (prose, F.repeat(pick("rep", "1a", "xx0", "abc1", "00", "a1b2"), 8), 0),
        (prose, F.concat(word("ha"), F.lit("-"), word("hb"), F.lit("-"), number("n24", 999)), 0),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(kinds)))

    def of_kind(values: list) -> Column:
        """The value of the row's kind; no other kind's is computed."""
        out = F.when(kind == 0, values[0])
        for i, value in enumerate(values[1:], 1):
            out = out.when(kind == i, value)
        return out

    drawn = spark.range(0, rows, 1, 4).select("id", *[F.xxhash64(F.lit(seed), F.lit(i), "id").alias(f"draw{i}") for i in range(DRAWS)], *[F.sha2(F.concat_ws("|", F.lit(seed), F.lit(i), F.col("id")), 256).alias(f"bits{i}") for i in range(DRAWS)])
    made = stage_table(drawn, "secret-draws").select("id", of_kind([b for b, _, _ in kinds]).alias("before"), of_kind([c for _, c, _ in kinds]).alias("candidate"), of_kind([F.lit(x) for *_, x in kinds]).alias("label"), word("after").alias("next"))
    quote = F.regexp_extract("before", "[\"']$", 0)
    return made.select("before", "candidate", F.concat(quote, F.lit(" "), F.col("next")).alias("after"), "label").filter(F.length("candidate") >= 8)


class Forest:
    """Trees as nested tuples: (feature index, threshold, left, right), or the probability at a leaf."""

    def __init__(self, trees: list):
        self.trees = trees

    def score(self, features: Column) -> Column:
        """Mean probability over the trees, as an expression."""

        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            i, threshold, left, right = node
            return F.when(features[FEATURES[i]] <= threshold, walk(left)).otherwise(walk(right))

        total = walk(self.trees[0])
        for tree in self.trees[1:]:
            total = total + walk(tree)
        return total / len(self.trees)


def train_forest(findings: DataFrame, trees: int = 16, depth: int = 6, seed: int = 11) -> Forest:
    """A forest from labelled findings; their number is a bound of the caller's."""
    rows = findings.filter("candidate <> '' and label in (0, 1)").select(F.col("label").cast("double").alias("label"), describe(F.col("candidate"), F.col("before"), F.col("after")).alias("f")).select("label", "f.*")
    rows = stage_table(rows, "secret-findings")  # else each of the fit's jobs describes them again
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", subsamplingRate=0.8).fit(ready)

    def read(node):
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return float(stats[1] / sum(stats)) if len(stats) > 1 and sum(stats) else float(node.prediction())
        return int(node.split().featureIndex()), float(node.split().threshold()), read(node.leftChild()), read(node.rightChild())

    return Forest([read(t._java_obj.rootNode()) for t in model.trees])


def running_sums(lengths: Column) -> Column:
    """For each of an array's numbers the sum of those before it."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("sums"))
    inner = F.transform(blocks, lambda block: F.aggregate(block, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["sums"], F.array(s["at"])).alias("sums"))))
    return F.aggregate(inner, start, lambda s, x: F.struct((s["at"] + x["at"]).alias("at"), F.concat(s["sums"], F.transform(x["sums"], lambda n: n + s["at"])).alias("sums")), lambda s: s["sums"])


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _parts(text: Column) -> Column:
    """Struct of the candidates of a text and of the gaps around them, one gap more than candidates."""
    return F.struct(F.split(text, CANDIDATE, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"))


def _placed(parts: Column) -> Column:
    """Array of (candidate, before, after); before holds the candidate and the gap in front of it at most."""
    gap = lambda i: F.get(parts["gaps"], i)
    last = lambda i: F.coalesce(F.right(F.get(parts["found"], i - 1), F.lit(BEFORE)), F.lit(""))
    return F.transform(parts["found"], lambda c, i: F.struct(c.alias("candidate"), F.right(F.concat(last(i), F.right(gap(i), F.lit(BEFORE))), F.lit(BEFORE)).alias("before"), F.left(gap(i + 1), F.lit(16)).alias("after")))


def find_candidates(text: Column) -> Column:
    """Array of structs (start, candidate, before, after), start counted from 0, in order."""

    def located(parts: Column) -> Column:
        lengths = F.transform(parts["found"], lambda c, i: F.length(F.get(parts["gaps"], i)) + F.length(c))
        sums = _bound(lengths, running_sums)
        return F.zip_with(sums, F.transform(_placed(parts), lambda x, i: F.struct(F.length(F.get(parts["gaps"], i)).alias("gap"), x.alias("x"))), lambda at, p: F.struct((at + p["gap"]).alias("start"), p["x"]["candidate"].alias("candidate"), p["x"]["before"].alias("before"), p["x"]["after"].alias("after")))

    return _bound(_parts(text), located)


def scan_secrets(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, end, candidate_sha256, preview, score, is_secret): a row for each candidate; offsets from 0."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(find_candidates(F.col(text_col))).alias("c")).select("doc_id", "c.*")
    rows = rows.withColumn("f", describe(F.col("candidate"), F.col("before"), F.col("after"))).withColumn("score", forest.score(F.col("f")))
    start = F.col("start").cast("long")
    return rows.select("doc_id", start.alias("start"), (start + F.length("candidate")).alias("end"), F.sha2("candidate", 256).alias("candidate_sha256"), F.concat(F.substring("candidate", 1, 4), F.lit("...")).alias("preview"), "score", (F.col("score") >= threshold).alias("is_secret"))


def redact_secrets(docs: DataFrame, forest: Forest, text_col: str = "text", threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """docs with every secret in the text replaced by the mask; all rows and columns stay."""

    def masked(parts: Column) -> Column:
        # the trees name fields of the described candidate, so the plan holds each feature's expression once
        described = F.transform(_placed(parts), lambda x: F.struct(x["candidate"].alias("candidate"), describe(x["candidate"], x["before"], x["after"]).alias("f")))
        kept = F.transform(described, lambda x, i: F.concat(F.get(parts["gaps"], i), F.when(forest.score(x["f"]) >= threshold, F.lit(mask)).otherwise(x["candidate"])))
        return F.concat(F.array_join(kept, ""), F.element_at(parts["gaps"], -1))

    return docs.withColumn(text_col, _bound(_parts(F.col(text_col)), masked))
