"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are long runs with a digit, keys of a known form at the start of a run or after
``/``, ``=`` or ``.`` in it, values of any length assigned to a telling name, and private-key blocks. A random forest judges each by its length, character classes and transitions,
dictionary coverage, whether it looks like a path, and the words around it. It is trained
from labelled findings. All of it is column expressions and Spark's own forest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import settle

NAMES = "password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credential"
#: Repeated groups are possessive, as Java's matcher recurses over others; so is what could be read again and again.
BLOCK = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?=[A-Za-z0-9+/=\s:,.()-]{16})(?:[A-Za-z0-9+/=\s:,.()]++|-(?!----))++"
    r"-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
)
#: A telling name, what it may go on with, and the sign after it.
NAMED = rf"(?i:{NAMES})[A-Za-z0-9_-]{{0,200}}+[\"']?[\t ]*+\s{{0,3}}[=:]\s{{0,3}}[\t ]*+"
#: A quoted value goes to the quote that closes it on its line; without one, or without quotes, to a blank.
ASSIGNED = rf"{NAMED}(?:\"[^\"\n\r]++(?=\")|'[^'\n\r]++(?=')|[\"']?[^\s\"'<>]+)"
#: The password of a user in an address; the short look behind spares most places the long one.
LOGIN = r"(?<=:)(?<=://[^\s:@/]{1,64}:)[^\s@/\"'<>]+(?=@)"
KEY_FORMS = "AKIA|ASIA|gh[pousr]_|glpat-|sk_live_|sk-|pk_live_|xox[abpr]-|AIza|eyJ"
KEY_FORM = rf"(?:{KEY_FORMS})[A-Za-z0-9+/_=.-]{{12,}}"
KEY = rf"(?<![A-Za-z0-9+_~-]){KEY_FORM}"
#: A run ends where a key form begins inside it.
RUN = (
    rf"(?<![A-Za-z0-9+/_=.~-])(?=(?:[A-Za-z+_~-]++|[/=.](?!{KEY_FORM}))*+[0-9])"
    rf"(?:[A-Za-z0-9+_~-]++|[/=.](?!{KEY_FORM}))++(?<=[A-Za-z0-9+/_=.~-]{{12}})"
)
CANDIDATE = f"{BLOCK}|{ASSIGNED}|{LOGIN}|{KEY}|{RUN}"
VALUE = rf"(?s)^(?:{NAMED}[\"']?)?(.*)$"
AROUND = 48
MASK = "[SECRET]"

#: Words that names and paths are made of, longest first where one begins another.
DICTIONARY = (
    "application|available|component|configuration|connection|controller|directory|document|download|example|"
    "function|generator|identifier|interface|invalid|language|manager|message|network|package|password|placeholder|"
    "production|project|provider|reference|repository|request|resource|response|sample|schema|secret|section|server|"
    "service|session|settings|source|static|storage|string|system|template|upload|version|windows|account|address|"
    "archive|article|backup|branch|build|cache|change|class|client|commit|content|create|data|date|default|delete|"
    "error|event|field|file|format|group|home|html|image|index|input|item|json|label|level|line|link|list|local|"
    "main|make|model|module|name|node|number|object|order|output|page|path|post|python|query|read|report|result|"
    "root|rule|script|search|select|site|src|start|state|status|store|style|table|task|test|text|time|title|token|"
    "type|update|user|value|view|web|word|work|write|your|the|and|for|key|new|id"
)
NEGATIVE_WORDS = r"commit|revision|sha\d*|md5|checksum|digest|hash|uuid|guid|version|release|build|isbn|order|invoice|phone|tel|card|ip|address|example|placeholder|dummy|sample"


#: What begins a key form, and what a key block holds.
MARKS = ("AKIA", "ASIA", "gho_", "ghp_", "ghu_", "ghs_", "ghr_", "glpat-", "sk_live_", "sk-", "pk_live_", "xox", "AIza", "eyJ", "BEGIN ")


def possible(text: Column) -> Column:
    """Whether a text can hold a candidate at all: each has a digit, ``=``, ``:`` or one of ``MARKS``.

    This is cheap beside the search for candidates, which other texts are spared.
    """
    return F.coalesce(reduce(Column.__or__, (F.contains(text, F.lit(m)) for m in MARKS), text.rlike("[0-9=:]")), F.lit(False))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None):
    """A row per candidate: the id (and ``keep``), its ``number`` in the text, ``start`` and ``length`` in characters, ``value`` and its surroundings.

    Splitting a text at its candidates gives what lies between them, so places and
    surroundings need no second search. A null text has none.
    """
    text = F.col(text_col)
    pattern = F.lit(CANDIDATE)
    found = docs.where(possible(text)).select(*(keep or [id_col]), text.alias("_text"))
    found = found.select(
        *(keep or [id_col]),
        F.regexp_extract_all("_text", pattern, F.lit(0)).alias("_hits"),
        F.split("_text", CANDIDATE, -1).alias("_gaps"),
    )
    # Running sums of lengths by doubling: each pass adds what stands 1, 2, 4 ... places before.
    found = found.withColumn("_ends", F.expr("transform(_hits, (h, i) -> cast(length(h) + length(get(_gaps, i)) as long))"))
    sums = F.expr(
        "aggregate(sequence(0, cast(ceil(log2(greatest(size(_hits), 1))) as int)), _ends, (a, k) -> zip_with(a,"
        " slice(concat(array_repeat(0L, shiftleft(1, k)), a), 1, size(a)), (x, y) -> x + y))"
    )
    each = found.where(F.size("_hits") > 0).withColumn("_ends", sums).select(
        *(keep or [id_col]),
        F.explode(
            F.expr(
                f"transform(_hits, (h, i) -> named_struct('number', i, 'at', get(_ends, i) - length(h), 'hit', h,"
                f" 'before', right(get(_gaps, i), {AROUND}), 'after', left(get(_gaps, i + 1), {AROUND})))"
            )
        ).alias("_c"),
    )
    value = F.when(F.startswith("_c.hit", F.lit("-----BEGIN")), F.col("_c.hit")).otherwise(
        F.regexp_extract("_c.hit", VALUE, 1)
    )
    name = F.expr("left(_c.hit, length(_c.hit) - length(value))")
    return (
        each.withColumn("value", value)
        .withColumn("before", F.concat("_c.before", name))
        .select(
            *(keep or [id_col]),
            F.col("_c.number").alias("number"),
            (F.col("_c.at") + F.length("_c.hit") - F.length("value")).cast("long").alias("start"),
            F.length("value").cast("long").alias("length"),
            "value",
            "before",
            F.col("_c.after").alias("after"),
        )
    )


def _count(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)).cast("double")


def features(found: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add the forest's features to rows with ``value``, ``before`` and ``after``."""
    value, before, after = F.col("value"), F.lower(F.col("before")), F.lower(F.col("after"))
    size = F.greatest(F.length(value), F.lit(1)).cast("double")
    near = F.right(before, F.lit(24))
    moves = [_count(value, f"(?<=[{a}])[{b}]") for a, b in (("a-z", "0-9"), ("0-9", "a-z"), ("a-z", "A-Z"), ("A-Z", "a-z"), ("A-Z", "0-9"), ("0-9", "A-Z"))]
    known = F.length(F.regexp_replace(F.lower(value), DICTIONARY, ""))
    columns = {
        "f_length": F.length(value).cast("double"),
        "f_digits": _count(value, "[0-9]") / size,
        "f_lower": _count(value, "[a-z]") / size,
        "f_upper": _count(value, "[A-Z]") / size,
        "f_other": _count(value, "[^A-Za-z0-9]") / size,
        "f_moves": reduce(Column.__add__, moves) / size,
        "f_letter_digit": (moves[0] + moves[1]) / size,
        "f_distinct": F.array_size(F.array_distinct(F.split(value, ""))).cast("double")
        / F.least(size, F.lit(256)),
        "f_repeat": _count(value, r"(.)\1{2}") / size,
        "f_dictionary": 1 - known / size,
        "f_hex": value.rlike("^[0-9a-fA-F]+$").cast("double"),
        "f_number": value.rlike("^[0-9.,:/+-]+$").cast("double"),
        "f_uuid": value.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$").cast("double"),
        "f_path": value.rlike(r"^[\w.~-]*+(?:/[\w.~-]{2,40}+){2,}+$|\.[a-z]{2,4}\d?$").cast("double"),
        "f_word_form": value.rlike("^(?:[A-Z]?[a-z]{3,}+[0-9]{0,4}+[_.-]?+)++$").cast("double"),
        "f_key_form": value.rlike(f"^({KEY_FORMS})|^-----BEGIN").cast("double"),
        "f_name_before": before.rlike(f"{NAMED}$").cast("double"),
        "f_name_near": before.rlike(NAMES).cast("double"),
        "f_assigned": before.rlike("[=:]\\s*+[\"']?$").cast("double"),
        "f_blanks": _count(value, r"\s") / size,
        "f_login": (before.rlike("://[^\\s/@]*:$") & after.rlike("^@")).cast("double"),
        "f_quoted": (near.rlike("[\"']$") & after.rlike("^[\"']")).cast("double"),
        "f_other_name": near.rlike(f"\\b({NEGATIVE_WORDS})\\b\\W{{0,4}}$").cast("double"),
        "f_other_near": before.rlike(f"\\b({NEGATIVE_WORDS})\\b").cast("double"),
        "f_mail": (near.rlike("@$") | after.rlike("^@")).cast("double"),
        "f_url": near.rlike("(://|www\\.)[^\\s]*$").cast("double"),
    }
    return found.select("*", *(c.alias(n) for n, c in columns.items())), list(columns)


def labelled_findings(spark: SparkSession, each: int = 150) -> DataFrame:
    """Labelled findings to train on where a team has none of its own: ``value, before, after, label``.

    Made by rule from hashes of row numbers: kinds of secrets, and kinds of long runs that
    are none, ``each`` of every kind. A label table from triage has the same columns.
    """
    hexes = "sha2(concat(kind, n), 256)"
    base = f"translate(base64(unhex({hexes})), '=', '')"
    alnum = f"translate(base64(unhex({hexes})), '+/=', 'aZ')"
    upper = f"upper(translate({alnum}, '0189', 'KQXW'))"
    digits = f"translate({hexes}, 'abcdef', '012345')"
    letters = f"translate({hexes}, '0123456789', 'ghijklmnop')"
    word = "element_at(array('report', 'section', 'module', 'service', 'index', 'table', 'value', 'client'), 1 + n % 8)"
    prose = "element_at(array('the line says ', 'Und der ', 'of this, ', '. Le ', 'que los ', ''), 1 + n % 6)"
    name = "element_at(array('token', 'secret', 'api_key', 'password', 'access_key', 'auth_key', 'TOKEN', 'apiKey'), 1 + n % 8)"
    sign = "element_at(array(' = \"', '=', ': ', ': \"', ' = \\'', '=\"'), 1 + int(n / 8) % 6)"
    end = "element_at(array('\" and', ' ', '\\n', '\", ', '\\' of', '\"'), 1 + int(n / 8) % 6)"
    word2 = "element_at(array('page', 'user', 'account', 'server', 'field', 'order', 'letter', 'system'), 1 + (n * 5) % 8)"
    letters3, letters4 = f"substr({letters}, 3, 4 + n % 3)", f"substr({letters}, 11, 5 + n % 4)"
    quoted = f"concat({prose}, {name}, element_at(array(' = ', ': ', '='), 1 + n % 3), '\"')"
    assigned, plain = f"concat({prose}, {name}, {sign})", prose
    kinds = [
        (1, f"left({hexes}, 40)", assigned, end),
        (1, f"left({hexes}, 32 + 32 * (n % 2))", assigned, end),
        (1, f"left({base}, 40)", assigned, end),
        (1, f"left({alnum}, 20 + n % 16)", assigned, end),
        (1, f"concat(left({alnum}, 6 + n % 5), substr('!#%&*', 1 + n % 5, 1), left({hexes}, 3))", assigned, end),
        (1, f"concat('AKIA', left({upper}, 16))", f"if(n % 3 = 0, {assigned}, {plain})", "' '"),
        (1, f"concat('ghp_', left(if(n % 2 = 0, {alnum}, {hexes}), 36))", f"if(n % 3 = 0, {assigned}, {plain})", "' '"),
        (1, f"concat('sk_live_', left({alnum}, 24))", f"if(n % 3 = 0, {assigned}, {plain})", "' '"),
        (1, f"concat('xoxb-', left({digits}, 12), '-', left({alnum}, 24))", f"if(n % 3 = 0, {assigned}, {plain})", "' '"),
        (1, f"concat('eyJ', left({base}, 30), '.eyJ', left({alnum}, 30), '.', left({base}, 40))", f"concat({prose}, 'Bearer ')", "' '"),
        (1, f"concat('-----BEGIN RSA PRIVATE KEY-----\\n', {base}, {alnum}, '\\n-----END RSA PRIVATE KEY-----')", plain, "'\\n'"),
        (0, f"left({hexes}, 40)", f"concat({prose}, element_at(array('commit ', 'sha1: ', 'revision ', 'checksum = '), 1 + n % 4))", "' '"),
        (0, f"left({hexes}, 32 + 32 * (n % 2))", f"concat({prose}, element_at(array('md5 ', 'sha256:', 'digest: ', 'hash '), 1 + n % 4))", "' '"),
        (0, f"concat(substr({hexes}, 1, 8), '-', substr({hexes}, 9, 4), '-', substr({hexes}, 13, 4), '-', substr({hexes}, 17, 4), '-', substr({hexes}, 21, 12))", f"concat({prose}, element_at(array('uuid ', 'id=', 'request ', ''), 1 + n % 4))", "' '"),
        (0, f"left({digits}, 12 + n % 8)", plain, "' and'"),
        (0, f"concat(left({digits}, 4), '-', substr({digits}, 5, 4), '-', substr({digits}, 9, 4), '-', substr({digits}, 13, 4))", f"concat({prose}, 'card ')", "' '"),
        (0, f"concat(100 + n % 150, '.', 10 + n % 240, '.', 1 + n % 200, '.', 100 + (n * 7) % 150)", plain, "' '"),
        (0, "concat(2000 + n % 30, '-0', 1 + n % 9, '-1', n % 9, 'T1', n % 9, '.00.00')", plain, "' '"),
        (0, f"concat('v', n % 9, '.', n % 20, '.', n % 7, '-rc.', n % 5, '-build', n)", f"concat({prose}, 'version ')", "' '"),
        (0, f"concat('src/', {word}, '/test/', {word}, n % 100, '.py')", plain, "' '"),
        (0, f"concat('/home/user/', {word}, '-', n, '/', {word}, '.html')", f"concat({prose}, 'example.com')", "' '"),
        (0, f"concat({word}, 'Manager', {word}, n % 50)", f"if(n % 3 = 0, {assigned}, {plain})", "' '"),
        (0, f"concat('your_', {word}, '_token_here', n % 10)", assigned, end),
        (0, f"concat(repeat(substr('xX0*', 1 + n % 4, 1), 12 + n % 8), n % 10)", assigned, end),
        (0, f"concat('mail', n % 100, '.example.com')", f"concat({prose}, left({hexes}, 3), '@')", "' '"),
        (0, f"concat({word}, '_', {word}, '_', 2000 + n % 30, '_', n % 13)", plain, "' '"),
        (1, f"concat(left({alnum}, 1 + n % 2), substr('!#%&*', 1 + n % 5, 1), left({digits}, 1 + n % 2))", assigned, end),
        (1, f"concat(left({letters}, 2 + n % 5), substr('!#%&*($', 1 + n % 7, 1), right({letters}, 2 + n % 4), substr('$!%', 1 + n % 5, 1), substr({letters}, 9, n % 5))", assigned, end),
        (1, "concat('-----BEGIN PRIVATE KEY-----\\n', array_join(transform(sequence(1, 5 + n), i -> base64(unhex(sha2(concat(n, '-', i), 256)))), '\\n'), '\\n-----END PRIVATE KEY-----')", plain, "'\\n'"),
        (0, f"concat('//', {word}, '.example.com/company/', {word}, '/backups/', n, '/', element_at(array('archive', 'nightly', 'q4', ''), 1 + n % 4))", f"concat({prose}, 'https:')", "element_at(array(' ', '/', '.'), 1 + n % 3)"),
        (0, "element_at(array('the', 'is', 'none', 'null', 'true', 'a', 'yes', 'your', 'this', 'for', '...', '-', 'on', 'no'), 1 + n % 14)", assigned, end),
        (1, f"concat({word}, ' ', {letters4}, ' ', {word2}, ' ', {letters3}, if(n % 2 = 0, concat(' ', {word}), ''))", quoted, "element_at(array('\"', '\" and', '\", '), 1 + n % 3)"),
        (1, f"concat({word}, element_at(array('pass', '', 'Pw', '_pw'), 1 + n % 4), n % 3, left({letters}, n % 6))", f"concat({prose}, element_at(array('postgres', 'mysql', 'https', 'amqp', 'redis'), 1 + n % 5), '://', element_at(array('admin', 'root', 'app', 'user'), 1 + n % 4), ':')", "concat('@db', n % 9, '.example')"),
        (1, f"left({alnum}, 8 + n % 12)", f"concat({prose}, 'mongodb://', {word}, ':')", "concat('@host', n % 9, ':27017/x')"),
        (1, f"concat('-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: GnuPG v2.', n, '\n\n', {base}, {alnum}, '\n-----END PGP PRIVATE KEY BLOCK-----')", plain, "'\n'"),
        (0, f"concat(element_at(array('must be at least ', 'is required for the ', 'not set in the ', 'enter the ', 'was sent to the '), 1 + n % 5), {word}, element_at(array('', ' of this ', ' and the '), 1 + n % 3), if(n % 3 = 0, '', {word2}))", quoted, "element_at(array('\"', '\" and', '\", '), 1 + n % 3)"),
        (0, f"concat('www.', {word}, '.example.org/page', n)", f"concat({prose}, 'https://')", "' '"),
    ]
    numbers = spark.range(each).select(F.col("id").cast("int").alias("n"))
    rows = F.array(
        *(
            F.struct(
                F.expr(value.replace("concat(kind, n)", f"concat('{k}-', n)")).cast("string").alias("value"),
                F.expr(before.replace("concat(kind, n)", f"concat('{k}-', n)")).cast("string").alias("before"),
                F.expr(after).alias("after"),
                F.lit(float(label)).alias("label"),
            )
            for k, (label, value, before, after) in enumerate(kinds)
        )
    )
    return numbers.select(F.explode(rows).alias("r")).select("r.*")


def train(findings: DataFrame, trees: int = 40, depth: int = 8, seed: int = 7) -> RandomForestClassificationModel:
    """A forest from labelled findings (``value, before, after, label`` 0 or 1)."""
    rows, names = features(findings)
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows.select("label", *names))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="0.5")
    return forest.fit(settle_vectors(rows))


def settle_vectors(rows: DataFrame) -> DataFrame:
    """Settle the assembled training rows, which are few."""
    return settle(rows.select("label", "features"), "findings")


def judge(found: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """Add ``probability`` of being a secret and ``secret`` (from 0.5 on) to candidates."""
    rows, names = features(found)
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    rows = model.setFeaturesCol("features").transform(rows).drop("rawPrediction", "prediction", "features", *names)
    return rows.withColumn("probability", vector_to_array("probability")[1]).withColumn(
        "secret", F.col("probability") >= 0.5
    )


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text"):
    """``<id_col>, start, length, value_sha256, probability, secret`` of every candidate in whole texts.

    Secrets themselves are not returned, only their places and digests. Null and empty texts
    have no candidates; repeated rows give repeated findings; an empty table gives none.
    """
    found = judge(candidates(docs, id_col, text_col), model)
    return found.select(id_col, "start", "length", F.sha2("value", 256).alias("value_sha256"), "probability", "secret")


def redact(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text"):
    """``docs`` with every secret in ``text_col`` replaced by ``MASK``; rows without secrets are unchanged.

    Only rows that may have candidates take part in a join: their secrets are joined back on id and
    digest of the text, ids null-safely.
    """
    some = possible(F.col(text_col))
    own = docs.where(some).select(F.struct(*docs.columns).alias("row"), F.md5(F.col(text_col)).alias("digest"))
    doc, text = F.col("row").getField(id_col), F.col("row").getField(text_col)
    known = own.select(doc.alias("doc"), text.alias("text"), "digest")
    found = judge(candidates(known, "doc", "text", ["doc", "digest"]), model)
    # Every candidate of a text with secrets, in order: the length of the secret, or null.
    told = F.when(F.col("secret"), F.col("length").cast("int"))
    spans = found.select("doc", "digest", "number", told.alias("length")).distinct().groupBy("doc", "digest")
    spans = spans.agg(F.sort_array(F.collect_list(F.struct("number", "length"))).alias("told"), F.count("length").alias("n")).where("n > 0")
    spans = settle(spans.select(F.col("doc").alias("s_doc"), F.col("digest").alias("s_digest"), "told"), "secret-spans")
    # The text again from what lies between its candidates, so no place in it is looked for.
    hits, gaps = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), F.split("text", CANDIDATE, -1)
    parts = F.expr(
        "concat(array_join(transform(hits, (h, i) -> concat(get(gaps, i), if(get(told, i).length is null, h,"
        f" concat(left(h, length(h) - get(told, i).length), '{MASK}')))), ''), element_at(gaps, -1))"
    )
    joined = own.join(spans, doc.eqNullSafe(F.col("s_doc")) & (F.col("digest") == F.col("s_digest")), "left")
    some_text = F.when(F.col("told").isNotNull(), text)
    joined = joined.select("row", "told", some_text.alias("text")).withColumns({"hits": hits, "gaps": gaps})
    new = F.when(F.col("told").isNull(), text).otherwise(parts)
    changed = joined.select(*(new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
    return docs.where(~some).union(changed)
