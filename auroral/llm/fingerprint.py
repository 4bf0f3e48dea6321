"""SimHash fingerprints and their search, in DataFrame operations only.

A text's terms are its pairs of consecutive words (its one word, if it has no
pair), and for short texts also its three-character pieces. Each term's 64-bit
hash votes, with the term's weight, for or against each bit; one hash
aggregation counts the votes.

``within_radius`` finds fingerprints within a Hamming radius by permuted block
tables: the bits are cut into blocks, and two fingerprints that differ in at most
``radius`` bits agree in all blocks but ``radius`` of them; for each choice of
agreeing blocks there is a table keyed by those blocks' bits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_bytes

SHORT_CHARS = 400
#: Votes of a pair of short words; fine enough that the weight of pieces has no jump at SHORT_CHARS.
UNIT = 64
#: Rows are put in order within buckets of neighbouring ids of about this much text.
BUCKET_BYTES = 14 << 20
MAX_BUCKETS = 10_000


def terms(text: Column) -> Column:
    """array<struct<a string, b string>> of a text's terms: its pairs of consecutive words; for short texts also pieces of three characters, without b.

    A text of one word is one such piece; leading and trailing white space makes an empty word.
    """
    kind = "array<struct<a:string,b:string>>"
    words = F.split(text, r"\s+")
    n = F.size(words)
    pairs = F.arrays_zip(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0)))).cast(kind)
    alone = F.when(n < 2, F.array(F.struct(text.alias("a"), F.lit(None).cast("string").alias("b")))).otherwise(F.expr(f"cast(array() as {kind})"))
    chars = F.length(text)
    pieces = F.when(
        (chars >= 1) & (chars < SHORT_CHARS),
        F.transform(F.sequence(F.lit(1), F.greatest(chars - 2, F.lit(1))), lambda i: F.struct(F.substring(text, i, F.lit(3)).alias("a"), F.lit(None).cast("string").alias("b"))),
    ).otherwise(F.expr(f"cast(array() as {kind})"))
    return F.concat(pairs, alone, pieces)


def simhash(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, fp long) of rows (*keys, text), one for each distinct key.

    A key must determine its text; rows of one key add up in proportion, which changes no bit. Each occurrence of a term votes
    with the term's weight: a pair with UNIT, and UNIT more for each of its words of over three characters; a piece with up to 8 UNIT,
    falling to nothing in equal steps as the text grows to ``SHORT_CHARS``. Bits are set where the votes for them are more than half.
    Null texts are empty. A bit's votes have a long of their own: at 3 UNIT for each of 20,000 words, 2 * 10**12 copies fit.
    """
    text = F.coalesce("text", F.lit(""))
    piece_weight = F.greatest(F.lit(1), F.floor((SHORT_CHARS - F.length(text)) * (8 * UNIT) / SHORT_CHARS)).cast("long")
    voted = texts.select(*keys, piece_weight.alias("pw"), F.explode(terms(text)).alias("t")).select(*keys, "pw", "t.a", "t.b")
    weighed = voted.select(*keys, F.xxhash64("a", "b").alias("h"), F.expr(f"if(b is null, pw, {UNIT}L * (1L + if(length(a) > 3, 1L, 0L) + if(length(b) > 3, 1L, 0L)))").alias("w"))
    sums = [F.sum(F.expr(f"(shiftrightunsigned(h, {j}) & 1L) * w")).alias(f"v{j}") for j in range(64)]
    counted = weighed.groupBy(*keys).agg(F.sum("w").alias("all"), *sums)
    # half of all votes from both sides: nothing is doubled, so nothing overflows
    bits = [F.when(F.col(f"v{j}") > F.col("all") - F.col(f"v{j}"), F.expr(f"shiftleft(1L, {j})")).otherwise(F.lit(0).cast("long")) for j in range(64)]
    fp = bits[0]
    for bit in bits[1:]:
        fp = fp.bitwiseOR(bit)
    return counted.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): each row with the text of the next row by descending doc_id; after the last comes the first.

    Rows of equal ids are ordered by text; null ids come last. Rows are ordered in buckets of neighbouring ids (at
    most ``MAX_BUCKETS``, cut at quantiles); the first row of the bucket after is added to each, so that no order of
    all rows is ever made in one task.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = max(1, min(MAX_BUCKETS, text_bytes(docs) // BUCKET_BYTES))
    ids = docs.select(F.col("doc_id").cast("long").alias("i"))
    cuts = sorted(set(ids.agg(F.percentile_approx("i", F.array(*[F.lit(k / n) for k in range(1, n)]) if n > 1 else F.array(F.lit(1.0)), F.lit(100_000))).first()[0] or [])) if n > 1 else []
    if cuts:
        bucket = lambda c: F.coalesce(F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < c)), F.lit(0))
    else:
        bucket = lambda c: F.lit(0)
    # the largest id of each bucket, at most MAX_BUCKETS rows
    heads = sorted(ids.where("i is not null").groupBy(bucket(F.col("i")).alias("b")).agg(F.max("i").alias("i")).collect())
    key = F.col("doc_id").cast("long")
    own = rows.select(bucket(key).cast("int").alias("b"), F.lit(0).alias("later"), "doc_id", "text")
    if heads:
        after = [(heads[k].b, heads[k - 1].i) for k in range(len(heads))]  # the lowest bucket is followed by the highest id
        if any(r.b == 0 for r in heads) is False:
            after.append((0, heads[-1].i))  # null ids alone make up bucket 0
            after[0] = (heads[0].b, heads[-1].i)
        spark = docs.sparkSession
        firsts = spark.createDataFrame(after, "b int, i long")
        ghosts = rows.join(F.broadcast(firsts), key == F.col("i")).select("b", F.lit(1).alias("later"), "doc_id", "text")
        own = own.unionByName(ghosts)
    order = Window.partitionBy("b").orderBy("later", F.col("doc_id").desc_nulls_last(), "text")
    # only where no row has an id is there no such first row: all are one bucket then, whose last is followed by its first
    first = F.first("text").over(order)
    return own.withColumns({"next_text": F.lead("text").over(order), "first_text": first}).where("later = 0").select("doc_id", "text", F.coalesce("next_text", "first_text").alias("next_text"))


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def fingerprint_with_edits(docs: DataFrame, radius: int = 3, every: int = 100) -> DataFrame:
    """For each row of (doc_id, text): n_chars, edited_sha256, fingerprint, edited_fingerprint (16 hex digits), near_edited, near_next, n_near.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many of the next document.
    Copies of a text share one row of votes. n_near is given for rows whose doc_id is divisible by ``every`` (null for
    others): how many other rows have a fingerprint within ``radius`` bits of this one's, by within_radius(). Repeated rows
    each give a row; null texts are empty.
    """
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    pairs = with_next(docs).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    keyed = pairs.select("doc_id", n.cast("long").alias("n_chars"), "text", "edited", F.sha2("edited", 256).alias("edited_sha256"), *[c.alias(f"{p}{k}") for p, s in (("t", "text"), ("e", "edited"), ("n", "next_text")) for k, c in enumerate(text_key(F.col(s)))])
    both = keyed.select(F.explode(F.array(F.struct(F.col("t0").alias("k0"), F.col("t1").alias("k1"), F.col("text")), F.struct(F.col("e0").alias("k0"), F.col("e1").alias("k1"), F.col("edited").alias("text")))).alias("x")).select("x.*")
    prints = simhash(both, ["k0", "k1"])
    named = lambda p: prints.select(F.col("k0").alias(f"{p}0"), F.col("k1").alias(f"{p}1"), F.col("fp").alias(f"{p}_fp"))
    out = keyed.drop("text", "edited").join(named("t"), ["t0", "t1"]).join(named("e"), ["e0", "e1"]).join(named("n"), ["n0", "n1"])
    out = materialise(out.select("doc_id", "n_chars", "edited_sha256", "t_fp", "e_fp", "n_fp"), "simhash-prints")
    asks = F.col("doc_id") % every == 0
    rows = out.groupBy(F.col("t_fp").alias("fp")).agg(F.count("*").alias("rows"))
    found = within_radius(out.where(asks).select(F.col("t_fp").alias("fp")), rows, radius, carry=("rows",))
    n_near = found.groupBy("query_fp").agg((F.sum("rows") - 1).alias("n_near"))
    told = out.where(asks).join(n_near.hint("merge"), F.col("t_fp") == F.col("query_fp")).drop("query_fp")
    told = told.unionByName(out.where(~F.coalesce(asks, F.lit(False))).withColumn("n_near", F.lit(None).cast("long")))
    spell = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return told.select("doc_id", "n_chars", "edited_sha256", spell("t_fp").alias("fingerprint"), spell("e_fp").alias("edited_fingerprint"), likeness(F.col("t_fp"), F.col("e_fp")).alias("near_edited"), likeness(F.col("t_fp"), F.col("n_fp")).alias("near_next"), "n_near")


#: Rows of prints that share a key of a block table are dealt out to so many tasks.
SALTS = 8


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 6, carry: tuple[str, ...] = ()) -> DataFrame:
    """(query_fp, fp, distance, *carry) for all distinct fingerprints of ``prints`` within ``radius`` bits of a distinct one of ``queries``.

    Both have a long column fp; rows with null are left out. ``carry`` names columns of ``prints``, which then has one row
    for each fp. No fingerprint is missed: there is a table for every choice of ``blocks - radius`` blocks, and a pair is
    returned by the first table in which it meets.
    """
    if not 0 <= radius < blocks <= 64:
        raise ValueError("0 <= radius < blocks <= 64")
    edges = [round(k * 64 / blocks) for k in range(blocks + 1)]
    masks = [((1 << edges[k + 1]) - (1 << edges[k])) for k in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tables = [signed(sum(masks[k] for k in keep)) for keep in combinations(range(blocks), blocks - radius)]
    masks_sql = F.array(*[F.lit(m) for m in tables])
    keys = lambda fp: F.posexplode(F.array(*[F.col(fp).bitwiseAND(F.lit(m)) for m in tables])).alias("table", "key")
    asked = queries.where("fp is not null").select(F.col("fp").alias("query_fp")).distinct()
    left = asked.select("query_fp", keys("query_fp")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = prints.where("fp is not null").select("fp", *carry)
    right = (held if carry else held.distinct()).select("fp", *carry, keys("fp"), F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt"))
    differs = F.col("query_fp").bitwiseXOR(F.col("fp"))
    first = F.array_position(F.transform(masks_sql, lambda m: differs.bitwiseAND(m) == 0), True)
    met = left.join(right.hint("merge"), (left["table"] == right["table"]) & (left["key"] == right["key"]) & (left["salt"] == right["salt"]) & (F.bit_count(differs) <= radius) & (first == left["table"] + 1))
    return met.select("query_fp", "fp", F.bit_count(differs).alias("distance"), *carry)
