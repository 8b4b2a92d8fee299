"""I-Match fingerprints with randomised lexicon subsets, in DataFrame operations only.

A text's terms are its distinct lower-cased runs of letters and digits. Document frequency is counted over the distinct terms of all
whole documents; the inverse-document-frequency band keeps terms of at least ``MIN_DF`` documents and at most ``MAX_SHARE`` of all. Of
the terms in the band, sorted by their hash, each randomised lexicon keeps a share: the hashes between a start and start + 2**64 / 2**j.
There are ``STARTS`` starts, and for each of them lexicons of all shares from 1 / ``STARTS`` (which together hold every term) to 1 / 2**``FINEST``. The
fingerprint is one hash for each lexicon that isn't empty, so a change of any term in the band changes it.

Likeness is worked out from two fingerprints alone. Of lexicons with a share r, about (1 - r)**d agree when d terms are in only
one of the texts; so the number of lexicons that differ grows with the logarithm of d, as that of those that aren't empty does with the number of
terms, and ``1 - (2**(differ / STARTS) - 1) / (2**(not empty / STARTS) - 1)`` estimates the share of common terms.

Terms outside the band leave by range of ids: the frequent ones are at most ``terms / (MAX_SHARE * documents)`` and go to all
ranges; a term of one document goes to the ranges that hold the document; a term that only an edited text has, where the two
texts meet, is looked up and goes to its range. Texts are shuffled by range, hashes of terms never are by document.

The edited text needs the next document by descending id. Documents are dealt into ranges of id and a hash of the text (so that ids that many
rows share are split as well), with a copy of each range's first document at the end of the range before it, so that one shuffle of the
texts is enough.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stored

#: Documents in a range of ids; most ranges: their bounds are in the plan, so beyond them ranges get more documents.
RANGE_DOCS, MOST_RANGES = 100, 1 << 17
#: The band: at least so many documents, and at most this share of all.
MIN_DF, MAX_SHARE = 2, 0.05
#: Starts of lexicons (a power of two); a lexicon's least share of the terms, as a power of 1 / 2.
STARTS, FINEST = 8, 20
_WIDEST = STARTS.bit_length() - 1
#: Lexicons of a start.
_EACH = FINEST - _WIDEST + 1


def _marks() -> list[int]:
    """Starts of lexicons and the ends of all but the widest, in order: the next start ends that one."""
    out = []
    for k in range(STARTS):
        start = -(2**63) + k * (2**64 // STARTS)
        out += [start, *[start + (1 << (64 - j)) for j in range(FINEST, _WIDEST, -1)]]
    return out


def terms_of(text: Column) -> Column:
    """The distinct terms' hashes."""
    words = F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def with_fingerprint(rows: DataFrame, terms: str, name: str) -> DataFrame:
    """Replaces the column of terms by the hashes of the lexicons, null where one is empty. Marks, sorted in among the terms, find the lexicons."""
    laid = F.sort_array(F.concat(terms, F.array(*[F.lit(m).cast("long") for m in _marks()])))
    at = F.filter(F.transform("_laid", lambda x, i: F.when(x.bitwiseAND(F.lit((1 << (64 - FINEST)) - 1)) == 0, i)), lambda i: i.isNotNull())

    def one(i: Column) -> Column:
        start = F.get("_at", i - i % _EACH)
        inner = i % _EACH + 1  # marks from the start on, up to the end
        stop = F.coalesce(F.get("_at", i + 1), F.size("_laid"))
        wide = F.when(inner == _EACH, F.lit(0xFFFFFFFF)).otherwise(F.lit(0xFFFF))
        return F.when(stop - start > inner, F.xxhash64(F.slice("_laid", start + 2, stop - start - 1)).bitwiseAND(wide))

    hashes = F.transform(F.sequence(F.lit(0), F.lit(STARTS * _EACH - 1)), one)
    return rows.withColumn("_laid", laid).withColumn("_at", at).withColumn(name, hashes).drop("_laid", "_at", terms)


def shown(hashes: Column, whole: Column) -> Column:
    """The fingerprint as a string; a text without a term in the band is its own hash."""
    text = F.array_join(F.transform(hashes, lambda v: F.coalesce(F.lower(F.hex(v)), F.lit(""))), ",")
    return F.when(F.size(F.filter(hashes, lambda v: v.isNotNull())) == 0, F.concat(F.lit("text:"), F.lower(F.hex(whole)))).otherwise(text)


def likeness(a: Column, b: Column, same: Column) -> Column:
    """0 to 1 from the hashes of two fingerprints; 1 if they are the same as strings."""
    pairs = F.filter(F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.coalesce((x == y).cast("int"), F.lit(0)))), lambda v: v.isNotNull())
    either, differ = F.size(pairs), F.size(F.filter(pairs, lambda v: v == 0))
    share = 1 - (F.pow(F.lit(2.0), differ / STARTS) - 1) / (F.pow(F.lit(2.0), either / STARTS) - 1)
    return F.when(same, F.lit(1.0)).when(either == 0, F.lit(0.0)).otherwise(share)


def _ranges(ids: DataFrame, n: int) -> Column:
    """An expression that gives the range of (_key, _tie), from the bounds of evenly dealt ranges."""
    count = max(1, min(MOST_RANGES, -(-n // RANGE_DOCS)))
    if count == 1:
        return F.lit(0)
    dealt = ids.repartitionByRange(count, "_key", "_tie").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(F.col("_key").alias("k"), F.col("_tie").alias("t"))).alias("s"))
    rows = dealt.orderBy("s").select("s.*").collect()[1:]  # a row a range
    cuts = [{"k": r["k"], "t": r["t"]} for r in rows]
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    one = f"struct<k:{ids.schema['_key'].dataType.simpleString()},t:bigint>"
    own = F.struct(F.col("_key").alias("k"), F.col("_tie").alias("t"))
    firsts = F.from_json(F.lit(json.dumps([g[0] for g in groups])), f"array<{one}>")
    nested = F.from_json(F.lit(json.dumps(groups)), f"array<array<{one}>>")
    coarse = F.size(F.filter(firsts, lambda s: s <= own))
    fine = F.size(F.filter(F.element_at(nested, F.greatest(coarse, F.lit(1))), lambda s: s <= own))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * width + fine)


def _by_order():
    return Window.partitionBy("bucket").orderBy("tail", F.col("_key").desc_nulls_last(), F.desc("_tie"))


def _dealt(docs: DataFrame, id_col: str, text_col: str):
    """A function that deals rows with _key and _tie into ranges, with the next range's first documents as each one's tail; the documents'
    keys and texts; and their number."""
    whole_number = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    base = docs.select(F.col(id_col).cast("long" if whole_number else "string").alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = base.select("_key", F.xxhash64("_text").alias("_tie"), "_text")
    ids = base.select("_key", "_tie")
    n = ids.count()
    where = _ranges(ids, n)
    own = F.struct(F.col("_key").alias("k"), F.col("_tie").alias("t"))
    firsts = {r["b"]: r["s"] for r in ids.groupBy(where.alias("b")).agg(F.max(own).alias("s")).collect()}  # a row a range
    order = sorted(firsts)
    tails = [{"k": firsts[b]["k"], "t": firsts[b]["t"], "dest": order[(i + 1) % len(order)]} for i, b in enumerate(order)]
    kind = ids.schema["_key"].dataType.simpleString()
    tail = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(tails)), f"array<struct<k:{kind},t:bigint,dest:int>>")))

    def deal(rows: DataFrame) -> DataFrame:
        found = rows.join(F.broadcast(tail), rows["_key"].eqNullSafe(tail["k"]) & (rows["_tie"] == tail["t"]), "left")
        return found.select(*rows.columns, F.explode(F.filter(F.array(
            F.struct(where.cast("int").alias("bucket"), F.lit(False).alias("tail")), F.struct(F.col("dest").alias("bucket"), F.lit(True).alias("tail"))),
            lambda s: s["bucket"].isNotNull())).alias("at")).select(*rows.columns, "at.bucket", "at.tail")

    return deal, base, n


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    The edited text has its last ``floor(n_chars / 3)`` code points replaced by the first as many (or all) of the next
    document's, by descending id; after the last comes the first. Returns id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Other columns are left out, so they can't clash.

    Defined cases: a null text is empty; a null id comes last in the order and is returned as null; ids that aren't whole numbers are in
    the order of strings; documents of one id are ordered by a hash of their text, descending; a single document is its own next; empty
    texts, and those without a term in the band, have a hash of the text as fingerprint; all terms of very long texts count; an empty
    table gives no rows.
    """
    deal, base, n = _dealt(docs, id_col, text_col)
    df = base.select("_key", "_tie", F.explode(terms_of(F.col("_text"))).alias("h")).groupBy("h").agg(F.count("*").alias("df"), F.max("_key").alias("_key"), F.max("_tie").alias("_tie"))
    df = stored(df, "imatch-df")
    most = max(MIN_DF, int(MAX_SHARE * n))
    frequent = F.broadcast(df.where(F.col("df") > most).agg(F.collect_list("h").alias("frequent")))  # one row

    cut = F.floor(F.char_length("_text") / 3).cast("int")
    none = F.array().cast("array<bigint>")
    # The condition, always true, is one that the planner adds for one of the two uses: with it both read the same exchange.
    rows = deal(base).where(F.col("bucket").isNotNull()).repartition("bucket").withColumn("next", F.coalesce(F.lead("_text").over(_by_order()), F.lit("")))
    rows = rows.withColumn("edited", F.concat(F.left("_text", F.char_length("_text") - cut), F.left("next", cut)))

    # Terms to drop in each range, besides the frequent ones: with MIN_DF 2, a term of too few documents has one, or is in none. The latter
    # stand where the two texts meet, or where the second is cut.
    run = r"(?<![\p{L}\p{N}])[\p{L}\p{N}]++$"
    kept, put = F.left("_text", F.char_length("_text") - cut), F.left("next", cut)
    met = F.concat(F.regexp_extract(kept, run, 0), F.regexp_extract(put, r"^[\p{L}\p{N}]+", 0))
    seam = rows.where(~F.col("tail") & (cut > 0)).select("bucket", F.explode(F.array(met, F.regexp_extract("edited", run, 0))).alias("w")).where("w <> ''")
    seam = seam.select("bucket", F.explode(terms_of(F.col("w"))).alias("h")).distinct()
    unknown = seam.join(df.where(F.col("df") >= MIN_DF).select("h").hint("merge"), "h", "left_anti").select("bucket", "h")
    rare = deal(df.where(F.col("df") < MIN_DF).select("_key", "_tie", "h")).select("bucket", "h")
    drops = rare.union(unknown).groupBy("bucket").agg(F.collect_list("h").alias("drops"))

    gone = F.concat(F.coalesce("drops", none), "frequent")
    rows = rows.join(drops.hint("merge"), "bucket", "left").crossJoin(frequent).withColumn("gone", gone).select(
        "bucket", "tail", "_key", "_tie", F.char_length("_text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("sha"), F.xxhash64("edited").alias("edited_hash"),
        F.array_except(terms_of(F.col("_text")), F.col("gone")).alias("to"), F.when(F.col("tail"), none).otherwise(F.array_except(terms_of(F.col("edited")), F.col("gone"))).alias("te"))
    rows = with_fingerprint(with_fingerprint(rows, "to", "own"), "te", "after")
    rows = rows.withColumn("fo", shown(F.col("own"), F.col("_tie"))).withColumn("fe", shown(F.col("after"), F.col("edited_hash")))
    rows = rows.withColumn("nx", F.lead(F.struct("own", "fo")).over(_by_order())).where(~F.col("tail"))
    return rows.select(
        F.col("_key").cast(docs.schema[id_col].dataType).alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), F.col("fo").alias("fingerprint"), F.col("fe").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("after"), F.col("fo") == F.col("fe")).alias("near_edited"), likeness(F.col("own"), F.col("nx.own"), F.col("fo") == F.col("nx.fo")).alias("near_next"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
