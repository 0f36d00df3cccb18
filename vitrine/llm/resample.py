"""Importance resampling: documents drawn by how much their hashed n-grams look like a target's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.numbering import numbered
from vitrine.sources.shared import materialize

#: Buckets that features are hashed into: the gain table has a row for each, so it is broadcast.
BUCKETS = 10_000
#: The longest run of words that is a feature.
LONGEST = 3
# what stands between words, after A-Z are lower-cased: all of ASCII but digits and small letters
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts all in ASCII, which their length tells, take the quicker function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    """The words of `text` as an array, empty for null."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _BREAK), lambda w: w != "")


def _runs(rows: DataFrame, buckets: int) -> tuple[DataFrame, list[str]]:
    """`rows` (words: array, other columns) with a row for each place in `words` (one of nulls if it has none) and the buckets of the runs that begin there.

    A run that would reach beyond the last word has null for a bucket.
    """
    place, said, parts, names = F.col("place"), F.col("word"), [], []
    placed = rows.select("*", F.posexplode_outer("words").alias("place", "word"))
    for n in range(LONGEST):
        said = F.concat(said, F.lit(" "), F.get("words", place + n)) if n else said
        names.append(f"bucket_{n + 1}")
        parts.append((F.crc32(said.cast("binary")) % buckets).cast("int").alias(names[-1]))
    return placed.select(*(c for c in rows.columns if c != "words"), *parts), names


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts each bucket holds, repeats counted; buckets without any have no row."""
    runs, names = _runs(texts.select(words_of(F.col(text_col)).alias("words")), buckets)
    return runs.select(F.explode(F.array(*names)).alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gain_table(source: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): a row for every bucket; floor(1000 * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of its counts s and t among S and T."""
    spark = source.sparkSession
    s, t = (bucket_counts(x, text_col, buckets).withColumnRenamed("n", name) for x, name in ((source, "s"), (target, "t")))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    counts = materialize(both, "gains")
    totals = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    more = [F.lit(float(totals[k] + buckets)) for k in ("s", "t")]
    own = [F.col(k).cast("double") + 1 for k in ("s", "t")]
    return counts.select("bucket", F.floor(1000 * F.ln((own[1] * more[0]) / (own[0] * more[1]))).alias("gain"))


def noise(id_col: str, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))): Gumbel noise from a digest of seed and id (null: empty), so that the highest sums are a draw without putting back."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Each row of `docs` with the weight of its features, its score and, if it is drawn, its rank: (`id_col`, n_features, weight, score, rank).

    Features are runs of one to three words, hashed by crc32 into `buckets`. A bucket's gain says how much more often the target has it; a text's
    weight is the sum of gains over its features. Of the N rows with `least_words` words or more, floor(percent * N / 100) with the highest scores
    (weight plus noise) are drawn and ranked from 1, ties to the smaller id; the others' rank is null. Other columns are not read.

    Null and empty texts have no features: weight 0. Rows alike each count and are drawn on their own. A null id has the noise of an empty one and goes
    first among ties. Without rows the result is empty; without a target every t is 0. Texts are read twice, whole, and never shuffled: what
    shuffles is a count for each bucket, then a row for each document.
    """
    gains = gain_table(docs, target, text_col, buckets)
    told = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), words_of(F.col(text_col)).alias("words"))
    runs, names = _runs(told.withColumn("n_words", F.size("words").cast("long")), buckets)
    for name in names:
        runs = runs.join(F.broadcast(gains.withColumnsRenamed({"bucket": name, "gain": f"gain_{name}"})), name, "left")
    gain = sum((F.coalesce(f"gain_{n}", F.lit(0)) for n in names), F.lit(0))
    summed = runs.groupBy("row", "id", "n_words").agg(F.sum(gain).alias("weight"))
    n = F.col("n_words")
    features = sum((F.greatest(n - k, F.lit(0)) for k in range(LONGEST)), F.lit(0)).cast("long").alias("n_features")
    scored = materialize(summed.select("id", "n_words", features, "weight", (F.col("weight") + noise("id", seed)).alias("score")), "scored")
    drawable = scored.where(n >= least_words)
    most = drawable.count() * percent // 100
    ranked = numbered(drawable.select("*", (-F.col("score")).alias("down")), ["down", "id"])
    rank = F.when(F.col("place") < most, F.col("place") + 1)
    rest = scored.where(n < least_words).withColumn("rank", F.lit(None).cast("long"))
    both = ranked.withColumn("rank", rank).drop("down", "place").unionByName(rest)
    return both.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
