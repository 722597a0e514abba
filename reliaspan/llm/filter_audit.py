"""Filter interaction audit: what each filter of a chain does, in every order of the filters.

Documents become cells first: the count of rows by part and by the set of filters they fail (a bit each),
in all, of good and of toxic rows. A recursive common table expression then extends filter prefixes by
letters not used yet. It carries the bits applied so far, joins the cells of the part, and each level of
the recursion emits the metrics of its step. The prefixes of k filters number k! * e at most, whatever
the number of documents; 325 for five.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliaspan.llm.common import in_slices
from reliaspan.session import materialise

#: The filters that `failures` and `cells` know; the bit of a letter is its place.
LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"
#: Null ids are dealt to so many tasks when labels are joined.
NULL_SHARES = 64

_CAPITALS = bytes(range(65, 91))
_CONTINUATION = bytes(range(0x80, 0xC0))


def failures(text: bytes | None) -> int:
    """The bits of A to D that a UTF-8 text fails; None is the empty text."""
    text = text or b""
    words = text.split()  # of bytes: at space and tab to carriage return
    n, kinds = len(words), len(set(words))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUATION))
    symbol = len(text.translate(None, SYMBOLS)) < len(text)
    return (n < MIN_WORDS) | (100 * kinds < MIN_DISTINCT_PERCENT * n) << 1 | (100 * capitals > MAX_CAPITAL_PERCENT * points) << 2 | symbol << 3


def failures_column(text: Column) -> Column:
    @F.arrow_udf("int")
    def run(texts: pa.Array) -> pa.Array:
        return in_slices(texts, failures, pa.int32())

    return run(text.cast("binary"))


def cells(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): the rows of docs by source (NULL: the empty string) and failed filters.

    A to D look at the text alone. E fails where a smaller doc_id has the identical text, compared by
    SHA-256; NULL and empty texts are identical to each other. A row without an id fails no E and makes
    no other row fail it; rows that share the smallest id all pass. good and toxic count the rows that
    some row of labels marks with quality 1 or toxic 1.

    Rows are added up by text, part and label before texts are compared, so copies never meet in one
    task one by one, and a hot part or text is summed where it is read.
    """
    text_col = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text_col.cast("binary"), 256)).alias("digest"),
        failures_column(text_col).alias("mask"),
    )
    salt = lambda other: F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64(other), F.lit(NULL_SHARES))).otherwise(0)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    marked = rows.withColumn("salt", salt("digest").cast("int")).join(marks.withColumn("salt", F.lit(0)), ["doc_id", "salt"], "left").na.fill(0, ["good", "toxic"])
    one_id = marked.groupBy("doc_id", "salt", "digest", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    lowest = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    texts = materialise(
        one_id.groupBy("digest", "part", "mask", "good", "toxic")
        .agg(F.sum("n").alias("n"), lowest.alias("low"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without_id"))
    )
    first = texts.groupBy("digest").agg(F.min("low.doc_id").alias("first_id"))
    compared = texts.join(first, "digest").withColumn("passing", F.col("without_id") + F.when(F.col("low.doc_id") == F.col("first_id"), F.col("low.n")).otherwise(0))
    both = F.array(F.struct(F.col("mask"), F.col("passing").alias("k")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("k")))
    split = compared.select("part", "good", "toxic", F.explode(both).alias("c")).filter("c.k > 0")
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.k").alias("n"), F.sum(F.col("c.k") * F.col("good")).alias("good"), F.sum(F.col("c.k") * F.col("toxic")).alias("toxic"))


def audit(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    `counted` holds (part, mask, n, good, toxic) with the bit of a letter at its place in `letters`; a
    part has 2^k cells at most, packed into one row. One row for each part, order of all letters and step
    from 1; the step's filter is the letter at that place. shapley is that filter's removed, summed over
    all orders. No cells give no rows. The recursion is written to the checkpoint folder before the prefixes are
    dealt to the orders, and its row limit is lifted for that, as its rows grow with the parts.
    """
    spark = counted.sparkSession
    k = len(letters)
    packed = materialise(counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")))
    filters = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(letters))
    total = lambda value, test: f"aggregate(filter(c.cells, x -> {test}), 0L, (s, x) -> s + x.{value})"
    fails, before = "x.mask & f.bit <> 0", "x.mask & p.applied"
    limit = "spark.sql.cteRecursionRowLimit"
    old = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        prefixes = materialise(spark.sql(f"""
            WITH RECURSIVE filters(letter, bit) AS (VALUES {filters}),
            steps(part, prefix, applied, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
                SELECT part, '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {{packed}}
                UNION ALL
                SELECT p.part, concat(p.prefix, f.letter), p.applied | f.bit, p.step + 1,
                       {total("n", f"x.mask & (p.applied | f.bit) = 0")}, {total("n", f"{fails} AND {before} = 0")},
                       {total("n", f"{fails} AND {before} <> 0")}, {total("n", "x.mask = f.bit")},
                       {total("good", f"{fails} AND {before} = 0")}, {total("toxic", f"{fails} AND {before} = 0")}
                FROM steps p JOIN filters f ON p.applied & f.bit = 0 JOIN {{packed}} c ON c.part = p.part
            )
            SELECT * FROM steps WHERE step > 0
        """, packed=packed))  # fmt: skip
    finally:
        spark.conf.set(limit, old)
    after = F.element_at(F.array(*[F.lit(math.factorial(i)) for i in range(k)]), k + 1 - F.col("step"))  # orders that begin with a prefix
    shares = prefixes.groupBy("part", F.substring("prefix", -1, 1).alias("letter")).agg(F.sum(F.col("removed") * after).alias("shapley"))
    orders = spark.sql(f"""
        WITH RECURSIVE filters(letter, bit) AS (VALUES {filters}),
        orders(filter_order, applied, step) AS (
            SELECT '', 0, 0 UNION ALL
            SELECT concat(o.filter_order, f.letter), o.applied | f.bit, o.step + 1 FROM orders o JOIN filters f ON o.applied & f.bit = 0
        )
        SELECT filter_order, substring(filter_order, 1, n) AS prefix FROM orders LATERAL VIEW explode(sequence(1, {k})) AS n WHERE step = {k}
    """)  # fmt: skip
    rows = prefixes.withColumn("letter", F.substring("prefix", -1, 1)).join(shares, ["part", "letter"]).join(F.broadcast(orders), "prefix")
    return rows.select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
