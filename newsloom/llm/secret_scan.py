"""Secret scans: candidates by pattern, a random forest to remove false positives.

The forest is Spark's own, fitted on labelled findings; fitted, it becomes a SQL expression over a
candidate's features (length, character transitions, dictionary coverage, path and neighbouring words),
so that scanning and redacting are projections without a shuffle. Only built-in functions are used.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shared import Scratch, first_by_hash, let

KEYWORD = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?!or(?!i[sz]))|credential|private[_-]?key)"
#: Candidates: private keys in PEM and tokens of three parts whole; what a keyword is assigned, 6 characters or more of any kind up to the quote or to a blank; keys with a
#: known prefix; runs of token characters, 12 or more, with a digit among them, base64 padding included.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[\s\S]*?-----END [A-Z ]{0,40}PRIVATE KEY-----|(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+|"
    rf"(?<=[:=\"' \t])(?<=[:=][ \t]{{0,4}}[\"']?)(?<=(?i:{KEYWORD})[A-Za-z_]{{0,12}}[\"']?[ \t]{{0,4}}[:=]{{1,2}}[ \t]{{0,4}}[\"']?)"
    r"(?:(?<=\")[^\"\r\n]{6,}+(?=\")|(?<=')[^'\r\n]{6,}+(?=')|(?![\"':=])[^\s\"']{6,})"
    r"|(?<![A-Za-z0-9+/_\-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9+/_\-])|(?:gh[pousr]_|sk-|xox[abp]-|AIza|eyJ)[A-Za-z0-9+/_\-]{12,}+={0,2}"
    r"|(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{12,}+={0,2})"
)
#: Characters of context on either side.
BEFORE, AFTER = 40, 12
#: Documents whose words the default labelled findings are made from, at most: the first by a hash of doc_id and text.
FIT_DOCS = 1_000
TREES, DEPTH, SEED = 20, 6, 7
CUT = 0.5
MARK = "[SECRET]"
#: Candidates of a text that one fold goes over.
CHUNK = 256
#: Frequent words and pieces of identifiers, at least three letters each (fixed values).
DICTIONARY = [
    "the", "and", "that", "for", "with", "this", "from", "have", "not", "are", "was", "but", "you", "all", "one",
    "tion", "ing", "ment", "que", "les", "des", "pour", "dans", "une", "est", "para", "los", "las", "por", "con",
    "der", "die", "und", "ist", "nicht", "ein", "mit", "auf", "sch", "ich", "user", "name", "file", "data", "test",
    "page", "index", "image", "http", "www", "com", "org", "net", "html", "json", "text", "version", "release",
    "update", "list", "item", "order", "number", "date", "time", "example", "sample", "config", "value", "type",
]
KEYWORDS = rf"(?i){KEYWORD}[A-Za-z_]{{0,12}}[\"']?\s*[:=]{{1,2}}\s*[\"']?$"
ASSIGNED = r"[:=]\s*[\"']?$"
HARMLESS = r"(?i)(commit|revision|sha-?1|sha-?256|md5|checksum|digest|uuid|guid|isbn|order|invoice|phone|tel|card|version|build|id)[\s:=#\"']*$"
KNOWN = r"^(-----BEGIN|AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-|AIza|eyJ)"
#: Paths on which labelled findings of any kind occur, samples among them.
PATHS = ["", "web", "src/client.py", "deploy/app.env", "config/site.yml", "docs/setup.md"]
SAMPLE_PATH = r"(?i)test|example|sample|docs?/"

FEATURES = ["length", "digits", "upper", "symbols", "hexadecimal", "transitions", "vowels", "distinct", "dictionary", "keyword", "assigned", "harmless", "known", "quoted", "slashes", "sample_path"]


def features(c: Column, before: Column, after: Column, path: Column) -> Column:
    """Struct of doubles, in the order of FEATURES."""
    n = F.length(c)
    share = lambda r: F.regexp_count(c, F.lit(r)) / n
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    letters = F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")
    values = [
        n.cast("double"), share("[0-9]"), share("[A-Z]"), share("[+/_=-]"), flag(F.rlike(c, F.lit("^([0-9a-f]+|[0-9A-F]+)$"))),
        share("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[+/_=-])(?=[^+/_=-])"),
        share("[aeiouAEIOU]"), F.size(F.array_distinct(F.split(c, ""))) / n, 1 - F.length(letters) / n,
        flag(F.rlike(before, F.lit(KEYWORDS))), flag(F.rlike(before, F.lit(ASSIGNED))), flag(F.rlike(before, F.lit(HARMLESS))), flag(F.rlike(c, F.lit(KNOWN))),
        flag(F.rlike(before, F.lit("[\"']$")) & F.rlike(after, F.lit("^[\"']"))), F.regexp_count(c, F.lit("/")).cast("double"), flag(F.rlike(path, F.lit(SAMPLE_PATH))),
    ]
    return F.struct(*[v.alias(k) for k, v in zip(FEATURES, values, strict=True)])


def labelled_findings(docs: DataFrame, rows: int = FIT_DOCS) -> DataFrame:
    """``(candidate, before, after, path, label)``: findings of known kinds, made by Spark from the words of at
    most ``rows`` documents and digests of their ids: keys, tokens and passwords in the ways that they
    are assigned (label 1); card and phone numbers, identifiers, paths, dates, versions, and digests that are
    named as such or stand bare, words and placeholders after a keyword, and made-up values in samples (label 0)."""
    base = first_by_hash(docs.where("text is not null").select("doc_id", "text"), rows, "doc_id", "text")
    base = base.select("doc_id", F.slice(F.split(F.lower("text"), r"[^a-z]+"), 1, 7).alias("ws"))
    pick = lambda k: F.coalesce(F.nullif(F.get("ws", F.lit(k)), F.lit("")), F.lit("page"))
    seed = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rnd = lambda k: F.sha2(F.concat(seed, F.lit(f"/{k}")), 256)
    b64 = lambda k: F.regexp_replace(F.base64(F.unhex(rnd(k))), r"[\r\n=]", "")
    upper = lambda k: F.translate(F.upper(rnd(k)), "0189", "GKQZ")
    letters = lambda k: F.translate(rnd(k), "0123456789", "kmrtwxyzhp")
    digits = lambda k: F.regexp_replace(F.concat(F.conv(F.substring(rnd(k), 1, 12), 16, 10), F.conv(F.substring(rnd(k), 20, 12), 16, 10)), "[^0-9]", "")
    prose = F.concat(pick(3), F.lit(" "), pick(4), F.lit(" "))
    q = F.lit('"')
    say = lambda t: F.concat(prose, F.lit(t))
    some = lambda lo, k: (F.lit(lo) + F.pmod(F.xxhash64(seed, F.lit(k)), F.lit(13))).cast("int")
    kinds = [
        (F.concat(F.lit("AKIA"), F.substring(upper(1), 1, 16)), prose, F.lit(" "), 1), (F.concat(F.lit("AKIA"), F.substring(upper(2), 1, 16)), say("aws_access_key_id="), F.lit(" "), 1),
        (F.substr(rnd(3), F.lit(1), some(12, 3)), say("password="), F.lit(" "), 1), (F.substr(rnd(4), F.lit(1), some(28, 4)), say('token = "'), q, 1), (F.substring(rnd(17), 1, 40), say('token = "'), q, 1),
        (F.substr(b64(5), F.lit(1), some(24, 5)), say("api_key: '"), F.lit("'"), 1), (F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(F.concat(b64(6), b64(7)), "[+/]", ""), 1, 36)), prose, F.lit(" "), 1),
        (F.substr(b64(8), F.lit(1), some(24, 8)), say("secret="), F.lit("\n"), 1),
        (F.substring(digits(9), 1, 16), prose, F.lit(" "), 0), (F.substring(digits(10), 1, 12), say("phone: "), F.lit(" "), 0), (F.substring(digits(18), 1, 16), say("card = "), F.lit(" "), 0),
        (F.concat(pick(1), pick(2), pick(5), F.lit("2024")), prose, F.lit(" "), 0), (F.concat(pick(1), F.lit("/"), pick(2), F.lit("/2024/"), pick(5)), say("/"), F.lit("."), 0),
        (F.concat(pick(1), F.lit("-"), pick(2), F.lit("-"), pick(5), F.lit("-"), F.substring(digits(11), 1, 3)), say("see "), F.lit(" "), 0), (F.concat(pick(1), F.lit("_"), pick(2), F.lit("_"), F.substring(digits(19), 1, 2)), say("name = "), F.lit("\n"), 0),
        (F.substring(rnd(12), 1, 40), say("commit "), F.lit(" "), 0), (F.substring(rnd(13), 1, 32), say("md5: "), F.lit("\n"), 0), (rnd(14), say("sha256:"), F.lit("\n"), 0), (F.substring(rnd(15), 1, 40), prose, F.lit(" "), 0),
        (F.concat(F.lit("2024-01-15T10-"), F.substring(digits(16), 1, 2)), prose, F.lit(" "), 0),
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), b64(30), F.lit("\n"), b64(31), F.lit("\n-----END RSA PRIVATE KEY-----")), prose, F.lit("\n"), 1),
        (F.concat(F.lit("eyJ"), F.substring(F.translate(b64(32), "+/", "-_"), 1, 20), F.lit(".eyJ"), F.translate(b64(33), "+/", "-_"), F.lit("."), F.translate(b64(34), "+/", "-_")), say("bearer "), F.lit(" "), 1),
        # letters alone, short ones and those with other characters; and what else follows a keyword
        (F.substr(letters(20), F.lit(1), some(8, 20)), say("password="), F.lit(" "), 1), (F.substr(letters(21), F.lit(1), some(12, 21)), say('secret: "'), q, 1), (F.concat(F.lit("AKIA"), F.upper(F.substring(letters(22), 1, 16))), prose, F.lit(" "), 1),
        (F.concat_ws(" ", pick(1), pick(2), pick(5), pick(6)), say('passphrase = "'), q, 1), (F.concat(F.initcap(F.substring(letters(23), 1, 4)), F.lit("!"), F.substring(rnd(23), 1, 3), F.lit("@$")), say("password: "), F.lit("\n"), 1), (F.substring(rnd(24), 1, 8), say("pwd="), F.lit(" "), 1),
        (F.concat(pick(1), pick(2)), say("token: "), F.lit(" "), 0), (F.rpad(pick(5), 6, "s"), say("secret: "), F.lit(" "), 0), (F.lit("required"), say("password: "), F.lit("\n"), 0), (F.concat(pick(2), F.lit("ing,")), say("password: "), F.lit(" "), 0),
        (F.concat(F.lit("get_"), pick(1), F.lit("(")), say("token = "), F.lit(")"), 0), (F.lit("${API_KEY}"), say('api_key = "'), q, 0),
    ]
    # most kinds occur on any path; made-up values that samples are assigned occur on a sample's path alone
    some_path = F.element_at(F.array(*[F.lit(x) for x in PATHS]), F.pmod(F.xxhash64(seed, F.lit(25)), F.lit(len(PATHS))).cast("int") + 1)
    sample_path = F.concat(F.lit("tests/"), pick(1), F.lit(".py"))
    kinds = [(*k[:3], some_path, k[3]) for k in kinds]
    kinds += [(F.substr(letters(26), F.lit(1), some(8, 26)), say('password = "'), q, sample_path, 0), (F.concat_ws(" ", pick(2), pick(3), pick(6)), say('secret = "'), q, sample_path, 0)]
    rows_ = F.array(*[F.struct(c.alias("candidate"), b.alias("before"), a.alias("after"), p.alias("path"), F.lit(float(y)).alias("label")) for c, b, a, p, y in kinds])
    return base.select(F.explode(rows_).alias("r")).select("r.*")


def fit_forest(findings: DataFrame):
    """A fitted forest, None without findings. The findings are few by their documented bound; their features are written once, since the
    fit reads them again and again, and ordered, so that reruns grow the same trees."""
    x = findings.where("candidate is not null").select("label", "candidate", features(*[F.col(c) for c in ("candidate", "before", "after", "path")]).alias("f"))
    x = Scratch(findings.sparkSession, "forest").save(x.select("label", "candidate", "f.*"))
    if x.isEmpty():
        return None
    x = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(x.coalesce(1).sortWithinPartitions("candidate", "label"))
    return RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(x)


def forest_table(model) -> list[list[dict]]:
    """The trees as lists of nodes: feature f (-1 in a leaf), threshold t, places l and r of the nodes below, prediction p."""

    def grow(node, out: list[dict]) -> int:
        me = len(out)
        if node.getClass().getSimpleName() == "LeafNode":
            out.append({"f": -1, "t": 0.0, "l": me, "r": me, "p": float(node.prediction())})
            return me
        out.append({"f": int(node.split().featureIndex()), "t": float(node.split().threshold()), "p": 0.0})
        out[me] |= {"l": grow(node.leftChild(), out), "r": grow(node.rightChild(), out)}
        return me

    trees: list[list[dict]] = [[] for _ in model.trees]
    for t, out in zip(model.trees, trees, strict=True):
        grow(t._call_java("rootNode"), out)
    return trees


def forest_expression(model, f: Column) -> Column:
    """Share of the forest's trees that vote for a secret, over the struct of features f; 0 without a forest
    (texts without a word to make findings from hold no candidate). The trees are one constant that is walked down, so that
    the plan stays small, whatever the forest's size."""
    if model is None:
        return F.lit(0.0)
    trees = forest_table(model)
    forest = F.from_json(F.lit(json.dumps(trees)), "array<array<struct<f:int,t:double,l:int,r:int,p:double>>>")
    steps = F.sequence(F.lit(1), F.lit(DEPTH))

    def vote(values, tree):
        def down(at, _):
            return let(F.get(tree, at), lambda n: F.when(n.f < 0, at).when(F.get(values, n.f) <= n.t, n.l).otherwise(n.r))

        return F.get(tree, F.aggregate(steps, F.lit(0), down)).p

    votes = let(F.array(*[f[name] for name in FEATURES]), lambda v: F.aggregate(forest, F.lit(0.0), lambda n, tree: n + vote(v, tree)))
    return votes / len(trees)


def _candidates(text: Column) -> Column:
    """Array of (start, c, b, a) in the order of the text: place, candidate and what stands before and after it.

    Places are running sums of lengths. A fold copies what it has at each step, so it goes over CHUNK candidates at a
    time, and over the chunks' sums before: many candidates cost little more than so many copies each."""
    split = F.struct(F.split(text, CANDIDATE, -1).alias("parts"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"))
    cut = let(split, lambda s: F.transform(s.found, lambda c, i: F.struct(c.alias("c"), F.get(s.parts, i).alias("b"), F.get(s.parts, i + 1).alias("a"))))
    width = lambda x: (F.length(x.b) + F.length(x.c)).cast("long")
    none = F.array().cast("array<struct<start:bigint,c:string,b:string,a:string>>")

    def step(s, x):
        one = F.struct((s.at + F.length(x.b)).cast("long").alias("start"), x.c.alias("c"), F.right(x.b, F.lit(BEFORE)).alias("b"), F.left(x.a, F.lit(AFTER)).alias("a"))
        return F.struct((s.at + width(x)).cast("long").alias("at"), F.array_append(s.out, one).alias("out"))

    def place(cut):
        chunk = lambda k: F.slice(cut, k * CHUNK + 1, F.lit(CHUNK))
        all_chunks = F.sequence(F.lit(0), F.floor((F.size(cut) - 1) / CHUNK).cast("int"))
        sums = F.transform(all_chunks, lambda k: F.aggregate(chunk(k), F.lit(0).cast("long"), lambda n, x: n + width(x)))
        starts = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
        inside = lambda at, k: F.aggregate(chunk(k), F.struct(at.alias("at"), none.alias("out")), step, lambda s: s.out)
        return let(starts, lambda at: F.flatten(F.transform(all_chunks, lambda k: inside(F.get(at, k), k))))

    return let(cut, lambda c: F.when(F.size(c) > 0, place(c)).otherwise(none))


def _findings(text: Column, path: Column, model) -> Column:
    """Array of (start, candidate, score) in the order of the text."""
    featured = F.transform(_candidates(text), lambda x: F.struct(x.start.alias("start"), x.c.alias("candidate"), features(x.c, x.b, x.a, path).alias("f")))
    return F.transform(featured, lambda x: F.struct(x.start.alias("start"), x.candidate.alias("candidate"), forest_expression(model, x.f).alias("score")))


def _path(docs: DataFrame, path_col: str) -> Column:
    return F.coalesce(F.col(path_col), F.lit("")) if path_col in docs.columns else F.lit("")


def with_findings(docs: DataFrame, model, path_col: str = "source") -> DataFrame:
    """``docs`` with ``findings``, an array of (start, candidate, score) over the whole text; empty for null and
    for texts without a candidate. A column of that name is replaced; a missing path column counts as empty."""
    path = _path(docs, path_col)
    return docs.drop("findings").withColumn("findings", _findings(F.coalesce(F.col("text"), F.lit("")), path, model))


def scan_secrets(docs: DataFrame, model, path_col: str = "source") -> DataFrame:
    """One row a candidate: doc_id, start (characters from 0), length, digest (SHA-256, so that results don't
    carry secrets), score, is_secret. Null and empty texts, and an empty table, give no row; repeated rows and null
    doc_ids are scanned like others; texts are read whole; a null path counts as empty; other columns aren't read."""
    # an outer explode: Spark would put a filter on the size of the array, computing it twice, under an inner one
    each = docs.select("doc_id", _path(docs, path_col).alias("path"), F.explode_outer(_candidates(F.coalesce(F.col("text"), F.lit("")))).alias("x")).where("x is not null")
    each = each.select("doc_id", "x.start", "x.c", features(F.col("x.c"), F.col("x.b"), F.col("x.a"), F.col("path")).alias("f"))
    each = each.select("doc_id", "start", "c", forest_expression(model, F.col("f")).alias("score"))
    return each.select("doc_id", "start", F.length("c").cast("long").alias("length"), F.sha2("c", 256).alias("digest"), "score", (F.col("score") >= CUT).alias("is_secret"))


def redact(docs: DataFrame, model, mark: str = MARK) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; everything else stays, null texts too."""
    name = "findings"
    while name in docs.columns:  # a column of the documents stays as it is
        name = f"_{name}"
    found = docs.withColumn(name, _findings(F.coalesce(F.col("text"), F.lit("")), _path(docs, "source"), model))
    both = F.struct(F.split("text", CANDIDATE, -1).alias("parts"), F.col(name).alias("found"))
    piece = lambda s: lambda x, i: F.concat(F.get(s.parts, i), F.when(x.score >= CUT, F.lit(mark)).otherwise(x.candidate))
    clean = let(both, lambda s: F.concat(F.array_join(F.transform(s.found, piece(s)), ""), F.element_at(s.parts, -1)))
    secret = F.exists(name, lambda x: x.score >= CUT)
    return found.withColumn("text", F.when(secret, clean).otherwise(F.col("text"))).select(*docs.columns)
