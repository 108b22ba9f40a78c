"""Document fingerprints by winnowing, in DataFrame expressions only.

Tokens are words in lower case (runs of letters of scripts without word spaces:
single characters).  Each run of ``k`` tokens gets a polynomial hash; of every
``w`` neighbouring hashes the least is kept, the rightmost of equal ones, with
its position.  Any common run of ``k + w - 1`` tokens gives a common hash, and
none shorter than ``k`` tokens does.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsfeat.llm.common import partitions, read

K = 4                 # tokens of a hashed run
W = 5                 # neighbouring hashes of which the least is kept
PRIME = 2_147_483_647
BASE = 1_000_003
BLOCKS = 8            # blocks of neighbouring documents per shuffle partition
MOST_BLOCKS = 65_536  # block bounds that the driver holds, at most; beyond, blocks grow (and spill)
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
TOKEN = rf"[{_UNSPACED}]|[^\s{_UNSPACED}]{{1,64}}"
_HIGH = 1 << 32       # a selected code is hash * 2^32 + (2^32 - 1 - position)


def winnow(df: DataFrame, text_col: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """Adds ``out``, an array of codes in text order; ``hashes`` and
    ``positions`` read them.  A text of fewer than ``k`` tokens has one hash over
    all of them, one without tokens (null, empty) an empty array.

    The steps are columns of their own: each array is named at least twice in
    the next step, so it is evaluated once a row and not once an element.
    """
    tokens, grams, codes = f"{out}__t", f"{out}__g", f"{out}__c"

    def gram(_, i: Column) -> Column:
        h = F.lit(0).cast("long")
        for back in range(k - 1, -1, -1):
            h = F.pmod(h * BASE + F.coalesce(F.get(tokens, i - back), F.lit(0)), F.lit(PRIME))
        return h

    def least(c: Column, i: Column) -> Column:
        return F.least(c, *[F.get(codes, i + ahead) for ahead in range(1, w)])

    first = F.least(F.lit(k), F.size(tokens))  # the first full run ends at this token, from 1
    return (df.withColumn(tokens, F.transform(
                F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TOKEN), F.lit(0)),
                lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME))))
            .withColumn(grams, F.transform(tokens, gram))
            .withColumn(codes, F.when(F.size(tokens) > 0, F.transform(
                F.slice(grams, first, F.size(grams)), lambda h, i: h * _HIGH + (_HIGH - 1 - i)))
                .otherwise(F.array().cast("array<bigint>")))
            .withColumn(out, F.when(F.size(codes) > 0, F.array_distinct(F.slice(
                F.transform(codes, least), F.lit(1), F.greatest(F.lit(1), F.size(codes) - w + 1))))
                .otherwise(F.col(codes)))
            .drop(tokens, grams, codes))


def hashes(codes: str) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(codes, lambda c: F.shiftright(c, 32)))


def positions(codes: str) -> Column:
    """(hash, number of the run's first token) of a fingerprint, in text order."""
    return F.transform(codes, lambda c: F.struct(F.shiftright(c, 32).alias("hash"),
                                                 (_HIGH - 1 - c.bitwiseAND(_HIGH - 1)).cast("int").alias("position")))


def digest(codes: str) -> Column:
    """A fingerprint's hashes and positions as one short string."""
    return F.sha2(F.array_join(F.col(codes).cast("array<string>"), ",").cast("binary"), 256)


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two arrays of distinct hashes (both empty: 1)."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        both / (F.size(a) + F.size(b) - both).cast("double"))


def with_next(df: DataFrame, id_col: str, tie: Column, ahead: dict[str, Column], after: list) -> DataFrame:
    """Rows with values of the next row in descending order of ``id_col`` (null
    ids last, then ``tie``); after the last row comes the first.

    Rows are cut into blocks of neighbours at quantiles of the id as a double
    (of ``tie`` for null ids, so that many of them are spread); ids that are equal
    as doubles share a block, where the ids themselves give the order.  The first
    rows of a block are sent to the block before it too, so one shuffle brings
    all neighbours together.  ``after`` are steps
    to apply to the blocks, before ``ahead`` ({new column: value of the next row}).
    """
    spark = df.sparkSession
    # Ids take keys up to 2^63 each way, null ids those around 3e19.
    keyed = df.withColumn("__tie", tie).withColumn("__key", F.coalesce(
        -F.col(id_col).cast("double"), F.col("__tie").cast("double") + F.lit(3e19)))
    lowest = keyed.agg(F.min("__key")).first()[0]
    count = min(BLOCKS * partitions(spark), MOST_BLOCKS)
    cuts = keyed.approxQuantile("__key", [i / count for i in range(1, count)], 0.25 / count) if lowest is not None else []
    bounds = sorted({lowest if lowest is not None else 0.0, *cuts})
    if len(bounds) > 1:
        keyed = Bucketizer(splits=[float("-inf"), *bounds[1:], float("inf")], inputCol="__key",
                           outputCol="__at").transform(keyed).withColumn("__at", F.col("__at").cast("int"))
    else:
        keyed = keyed.withColumn("__at", F.lit(0))
    opens = F.col("__key") == F.get(F.lit(bounds), F.col("__at"))
    before = F.pmod(F.col("__at") + (len(bounds) - 1), F.lit(len(bounds)))
    dealt = (keyed
             .select("*", F.posexplode_outer(F.when(opens, F.array("__at", before)).otherwise(F.array("__at")))
                     .alias("__ghost", "__block"))
             .repartition("__block"))
    for step in after:
        dealt = step(dealt)
    order = Window.partitionBy("__block").orderBy(
        "__ghost", "__key", F.col(id_col).desc_nulls_last(), "__tie")
    return (dealt.withColumns({name: F.lead(value).over(order) for name, value in ahead.items()})
            .where("__ghost = 0").drop("__key", "__at", "__tie", "__ghost", "__block"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next
    document; one row per input row.

    The edited text has the last third of its code points replaced by the first
    as many of the next document's.  Null counts as empty; repeated rows follow
    each other; a lone row is followed by itself; an empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    steps = [lambda d: d.withColumn("n", F.char_length("text").cast("long")),
             lambda d: winnow(d, "text", "fp"), lambda d: d.withColumn("own", hashes("fp"))]
    ahead = {"next_text": F.col("text"), "next_own": F.col("own")}
    rows = with_next(narrow, "doc_id", F.xxhash64("text"), ahead, steps)
    third = F.floor(F.col("n") / 3).cast("int")
    edited = rows.select("doc_id", "n", "fp", "own", "next_own", F.concat(
        F.substring("text", F.lit(1), F.col("n").cast("int") - third), F.substring("next_text", F.lit(1), third)).alias("edited"))
    return winnow(edited, "edited", "edited_fp").withColumn("edited_own", hashes("edited_fp"))


def q_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_edits(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("n").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                        digest("fp").alias("fingerprint"), digest("edited_fp").alias("edited_fingerprint"),
                        likeness("own", "edited_own").alias("near_edited"), likeness("own", "next_own").alias("near_next"),
                        F.size("fp").alias("n_hashes"))
