"""Document fingerprints by a homomorphic multiset hash: wide vectors hashed from paragraphs, summed modulo 2**32.

A document is the multiset of its lines. A line's vector has three parts, all of lanes modulo 2**32: EQUAL lanes of its SHA-256, by which
equal multisets are told from others; LIKE lanes, which count, for each bit of an MD5, the pieces of the line whose MD5 has the bit; and
the number of pieces; empty ones don't count. A document's fingerprint is the sum of its lines' vectors, whatever their order, so a line is put in or taken out by
adding or subtracting its vector. Twice a LIKE lane less the number of pieces is a sum of signs, one for each piece, so two
documents' sums of signs have the cosine that the documents have as bags of pieces, up to an error of about 1 / sqrt(LIKE).

Everything here is built-in functions of columns: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import discard, table, written

EQUAL, LIKE = 8, 64
LANES = EQUAL + LIKE + 1
#: Where a line is cut into pieces of a few words: marks, and blanks after letters that often end words. It depends on the text only, so
#: a change moves no cut elsewhere.
CUT = "[.,;:!?]|[dt] "
#: Copies of one row that are dealt to one task.
SPREAD = 1000
_MASK = (1 << 32) - 1


def summed(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The keys and the fingerprint, an array of lanes called lanes, of the text of each row. Rows of equal keys are one multiset."""
    lines = df.select(*keys, F.explode(F.split(text, "\n")).alias("line"))
    pieces = lines.select(*keys, "line", F.posexplode(F.split("line", CUT)).alias("at", "piece"))
    number = lambda hexed, i: F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long")
    hashed = pieces.select(*keys, F.when(F.col("at") == 0, F.sha2("line", 256)).alias("own"), F.when(F.col("piece") != "", F.md5("piece")).alias("part"))
    hashed = hashed.select(*keys, "own", F.shiftleft(number("part", 1), 32).bitwiseOR(number("part", 0)).alias("bits"))
    two = F.lit((1 << 32) + 1)  # two lanes are counted in a sum of 64 bits
    sums = [F.sum(F.coalesce(number("own", i), F.lit(0))).alias(f"e{i}") for i in range(EQUAL)]
    sums += [F.coalesce(F.sum(F.shiftrightunsigned("bits", k).bitwiseAND(two)), F.lit(0)).alias(f"b{k}") for k in range(LIKE // 2)]
    found = hashed.groupBy(*keys).agg(*sums, F.count("bits").alias("n"))
    low = lambda c: F.col(c).bitwiseAND(_MASK)
    lanes = [*(low(f"e{i}") for i in range(EQUAL)), *(low(f"b{k}") for k in range(LIKE // 2)), *(F.shiftrightunsigned(f"b{k}", 32) for k in range(LIKE // 2)), low("n")]
    return found.select(*keys, F.array(*lanes).alias("lanes"))


def inserted(lanes: Column | str, more: Column | str) -> Column:
    """The fingerprint of two multisets put together."""
    return F.zip_with(lanes, more, lambda a, b: (a + b).bitwiseAND(_MASK))


def deleted(lanes: Column | str, less: Column | str) -> Column:
    """The fingerprint without a part of the multiset."""
    return F.zip_with(lanes, less, lambda a, b: (a - b).bitwiseAND(_MASK))


def as_text(lanes: Column | str) -> Column:
    """Eight hexadecimal digits for each lane."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def _signs(lanes: Column) -> Column:
    n = F.get(lanes, F.lit(LANES - 1)).cast("double")
    return F.transform(F.slice(lanes, EQUAL + 1, LIKE), lambda x: 2 * x.cast("double") - n)


def likeness(a: Column | str, b: Column | str) -> Column:
    """0 to 1: the cosine of the sums of signs, and 0 where that is negative; 1 for equal fingerprints."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    x, y = _signs(a), _signs(b)
    both = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(a == b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / both)))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and lanes: one multiset for each distinct id, of the lines of all its rows' whole texts (null: empty, one empty line)."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return summed(docs, ["doc_id"], "text")


def _following(docs: DataFrame) -> DataFrame:
    """docs: key, doc_id, text. For each key: doc_id, n_chars, n (how many rows there are of it) and next, the key that follows.

    Only numbers are sorted, in ranges; the last one of each range is followed by the first one of the next range that has any.
    """
    numbers = docs.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max(F.char_length("text")).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("n"))
    order = [F.asc_nulls_last("doc_id"), F.asc("key")]
    ordered = numbers.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ordered = written(ordered.withColumn("part", F.shiftright("at", 33).cast("int")), "multiset-order")
    ranges = Window.orderBy("part")  # a row for each range
    whole = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = ordered.groupBy("part").agg(F.min_by("key", "at").alias("first"))
    first = first.select("part", F.coalesce(F.lead("first").over(ranges), F.first("first").over(whole)).alias("after"))
    inside = F.lead("key").over(Window.partitionBy("part").orderBy("at"))
    found = ordered.withColumn("inside", inside).join(F.broadcast(first), "part").select("key", "doc_id", "n_chars", "n", F.coalesce("inside", "after").alias("next"))
    found = written(found, "multiset-next")
    discard(ordered)
    return found


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df, whose texts are whole (null: empty): doc_id, n_chars; the edited text's SHA-256; the fingerprints of both
    texts; and the likeness of the text's fingerprint to the edited text's and to the next document's.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document, in
    ascending order of ids, null ids last; the first follows the last. Of different texts under one id, the order is that of an MD5 of id
    and text; of repeated rows each is followed by the next copy, and the last one by what comes after them. A lone document follows
    itself. Texts meet once by key, each with the start of the next one; a repeated row's text is moved once, whatever the copies.
    A text's pieces are held while it is cut: about 100 bytes for a piece of a line.
    """
    doc_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text)))
    docs = df.select(key.alias("key"), doc_id.alias("doc_id"), text.alias("text"))
    follow = _following(docs)
    most = follow.agg(F.max("n")).first()[0] or 0
    texts = docs.select("key", "text")
    texts = texts.dropDuplicates(["key"]) if most > 1 else texts
    vectors = written(summed(texts, ["key"], "text"), "multiset-vectors")
    links = follow.select(F.col("next").alias("key"), F.col("key").alias("to"), "doc_id", "n_chars", F.lit(1).cast("long").alias("copies"))
    if most > 1:
        links = links.unionByName(follow.where("n > 1").select("key", F.col("key").alias("to"), "doc_id", "n_chars", (F.col("n") - 1).alias("copies")))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    starts = links.join(texts, "key").select(F.col("key").alias("next"), F.col("to").alias("key"), "doc_id", "n_chars", "copies", F.substring("text", F.lit(1), half).alias("start"))
    edited = starts.join(texts, "key").withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.col("start")))
    keys = ["key", "next", "doc_id", "n_chars", "copies", "edited_sha256"]
    new = summed(edited.withColumn("edited_sha256", F.sha2("edited", 256)).select(*keys, "edited"), keys, "edited").withColumnRenamed("lanes", "new")
    rows = new.join(vectors, "key").join(vectors.select(F.col("key").alias("next"), F.col("lanes").alias("other")), "next")
    if most > 1:
        rows = rows.withColumn("dealt", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / SPREAD).cast("long"))))
        rows = rows.repartition("key", "dealt") if most > SPREAD else rows
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(SPREAD), F.col("copies") - F.col("dealt") * SPREAD))))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text("lanes").alias("fingerprint"),
        as_text("new").alias("edited_fingerprint"),
        likeness("lanes", "new").alias("near_edited"),
        likeness("lanes", "other").alias("near_next"),
    )


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    number = lambda text, i: f"('0x' || substring({text}, {8 * i + 1}, 8))::BIGINT"
    equal = ", ".join(f"sum(CASE WHEN pos = 1 THEN {number('own', i)} ELSE 0 END)::BIGINT & {_MASK}" for i in range(EQUAL))
    like = ", ".join(f"coalesce(sum(({number('part', k // 32)} >> {k % 32}) & 1), 0)::BIGINT" for k in range(LIKE))
    lanes = f"[{equal}, {like}, count(part)]"
    signs = lambda v: f"list_transform({v}[{EQUAL + 1}:{EQUAL + LIKE}], lambda x: 2 * x::DOUBLE - {v}[{LANES}])"
    dot = lambda a, b: f"list_sum(list_transform(list_zip({signs(a)}, {signs(b)}), lambda p: p[1] * p[2]))"
    near = lambda a, b: f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN sqrt({dot(a, a)} * {dot(b, b)}) = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {dot(a, b)} / sqrt({dot(a, a)} * {dot(b, b)}))) END"
    text = lambda v: f"array_to_string(list_transform({v}, lambda x: printf('%08x', x)), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS after, coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next FROM d),
e AS (SELECT doc_id, next, n, text, substring(text, 1, n - n // 2) || substring(after, 1, n // 2) AS edited FROM o),
l AS (SELECT doc_id, kind, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM (SELECT doc_id, 0 AS kind, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e)),
p AS (SELECT doc_id, kind, own, pos, CASE WHEN piece <> '' THEN md5(piece) END AS part FROM (SELECT doc_id, kind, sha256(line) AS own, generate_subscripts(string_split_regex(line, '{CUT}'), 1) AS pos, unnest(string_split_regex(line, '{CUT}')) AS piece FROM l)),
v AS (SELECT doc_id, kind, {lanes} AS v FROM p GROUP BY doc_id, kind)
SELECT e.doc_id, n AS n_chars, sha256(edited) AS edited_sha256, {text('a.v')} AS fingerprint, {text('b.v')} AS edited_fingerprint, {near('a.v', 'b.v')} AS near_edited, {near('a.v', 'c.v')} AS near_next
FROM e JOIN v a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN v b ON b.doc_id = e.doc_id AND b.kind = 1 JOIN v c ON c.doc_id = e.next AND c.kind = 0
"""


ORACLE = _oracle()
