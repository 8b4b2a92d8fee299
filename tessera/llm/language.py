"""Language identification by fusing text likelihoods, declared markup language and address priors.

Each text gets the log-likelihood of its byte trigrams under every language (hashed multinomial models), and under "none", a
uniform model that stands for what is no language. Then, by Bayes' rule, ``tempered text likelihood x P(declared | language) x
P(language | host)``. The likelihood of a declaration is a smoothed table of declared against text languages; the priors of hosts
are smoothed towards their domain's, those towards their suffix's, and those towards all rows'. All of these tables are grouped
aggregations over all rows, summed before the shuffle; only a host's row count is ever a key's size.

The trigram models are the one thing learned from a sample: at most about ``SAMPLE_PER_LANGUAGE`` labelled rows of each language,
chosen by a hash of the id.

Scale: one pass over the texts, whose result (a few numbers a row) is stored; the host priors come back by a join that is
split at run time where a host is hot. Every declared language with ``LEAST_LABELLED`` rows has a model. Counts of trigrams reach the
driver as one fixed-size table per language, one at a time; driver and workers hold all tables (0.5 and 0.26 MB a language). Documents
declared in a language of fewer rows are accepted where the models see no language.
"""

from __future__ import annotations

import html as html_entities
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import stored
from .url_filter import host_of

#: Bound on the labelled sample; tasks that count it; languages with fewer labelled rows have no model.
SAMPLE_PER_LANGUAGE, SAMPLE_TASKS, LEAST_LABELLED = 400, 4, 5
#: Trigram buckets; weight of the text's log-likelihood (neighbouring trigrams share letters); smoothing of tables and priors.
BUCKETS, TEMPER, DECLARED_SMOOTH, PRIOR_WEIGHT = 1 << 16, 1 / 3, 0.5, 10.0
#: Prior of "none"; a row is accepted if its language is one, with at least this probability.
NONE, NONE_PRIOR, ACCEPT = "none", 0.01, 0.5

_TAGS = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?-->|<[^>]*>")
_LANG = r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z]+)"""


def buckets_of(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bucket of the trigram at each byte; ``BUCKETS`` where it would cross a border or has a digit."""
    low = tb.lower_ascii(raw)
    out = np.full(len(raw), BUCKETS, np.int32)
    if len(raw) < 3:
        return out
    x = low.astype(np.uint32)
    h = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    digit = (low - np.uint8(48)) < 10
    out[:-2] = np.where(digit[:-2] | digit[1:-1] | digit[2:], BUCKETS, h >> np.uint32(16))
    for back in (1, 2):
        ends = offsets[1:] - back
        ok = (ends >= 0) & (ends >= offsets[:-1])
        out[ends[ok]] = BUCKETS
    return out


def normal(lang: Column) -> Column:
    """A declared language's first subtag in lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(lang.cast("string"), F.lit("")), r"^\s*([A-Za-z]+)", 1)), F.lit(""))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log-probabilities of trigram buckets by language (a last bucket of 0, a last row of "none")."""
    rows = labelled.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), normal(F.col(lang_col)).alias("l"))
    counts = {r["l"]: r["n"] for r in rows.where("l is not null").groupBy("l").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_LABELLED).collect()}
    langs = sorted(counts)
    table = np.zeros((len(langs), BUCKETS + 1))
    if langs:
        shares = F.from_json(F.lit(json.dumps({x: min(1.0, SAMPLE_PER_LANGUAGE / counts[x]) for x in langs})), "map<string,double>")
        share = F.coalesce(F.try_element_at(shares, F.col("l")), F.lit(0.0))
        sample = rows.where(F.pmod(F.xxhash64("i", "l"), F.lit(1_000_003)) < share * 1_000_003)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come sorted by language: one language's table at a time."""
            now, sums = None, np.zeros(BUCKETS + 1, np.int64)
            row = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sums.tobytes()], pa.binary())], names=["l", "c"])
            for b in batches:
                for part in tb.slices(b, "t"):
                    raw, offsets = tb.buffers(part.column(0))
                    at = buckets_of(raw, offsets)
                    for k, x in enumerate(part.column(1).to_pylist()):
                        if x != now:
                            if now is not None:
                                yield row()
                            now, sums = x, np.zeros(BUCKETS + 1, np.int64)
                        sums += np.bincount(at[offsets[k] : offsets[k + 1]], minlength=BUCKETS + 1)
            if now is not None:
                yield row()

        place = {x: k for k, x in enumerate(langs)}
        for r in sample.select("t", "l").repartition(SAMPLE_TASKS, "l").sortWithinPartitions("l").mapInArrow(count, "l string, c binary").toLocalIterator():
            table[place[r["l"]]] += np.frombuffer(r["c"], np.int64)
    table = table[:, :BUCKETS] + 0.05
    logs = np.concatenate([np.log(table / table.sum(1, keepdims=True)), np.full((1, BUCKETS), -np.log(BUCKETS))])
    return langs, np.concatenate([logs, np.zeros((len(langs) + 1, 1))], 1)


def score_texts(rows: DataFrame, langs: list[str], logs: np.ndarray, markup: bool) -> DataFrame:
    """Adds ``ll``, the log-likelihoods by language and "none", to rows with a column ``_text``, which goes."""
    others = [f for f in rows.schema.fields if f.name != "_text"]
    names = [f.name for f in others] + ["ll"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", ll array<double>"
    shared = rows.sparkSession.sparkContext.broadcast(logs.astype(np.float32))  # a table of BUCKETS for each language

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            for part in tb.slices(b, "_text"):
                k = part.schema.get_field_index("_text")
                column = part.column(k)
                if markup:
                    plain = (_TAGS.sub(" ", x) if x else "" for x in column.to_pylist())
                    column = pa.array([html_entities.unescape(x) if "&" in x else x for x in plain], pa.string())
                raw, offsets = tb.buffers(column)
                at = buckets_of(raw, offsets)
                full = np.flatnonzero(np.diff(offsets) > 0)
                out = np.zeros((part.num_rows, len(table)))
                if len(full):
                    for j in range(len(table)):
                        out[full, j] = np.add.reduceat(table[j][at], offsets[full], dtype=np.float64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(part.num_columns) if i != k] + [pa.array(list(out), pa.list_(pa.float64()))], names=names)

    return rows.select(*[f.name for f in others], "_text").mapInArrow(work, schema)


def _best(values: Column, langs: list[str]) -> Column:
    names = F.array(*[F.lit(x) for x in [*langs, NONE]])
    return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))


def identify(rows: DataFrame, langs: list[str], logs: np.ndarray, markup: bool = False) -> DataFrame:
    """Languages of rows with the columns ``_text``, ``_declared`` (or null) and ``_host`` (or empty); others are kept.

    Adds text_lang (by the text alone), lang, confidence (the posterior probability of lang) and accepted; takes away ``_text``.

    Defined cases: an empty or null text has no likelihood, so that declaration and host decide; a null declaration
    says nothing; one of a language without a model counts where the rest says "none": the row has that language, is accepted, and its
    confidence is null; rows without a host share the empty host's prior; of languages that are equally likely the first by name counts; very
    long texts are read whole; repeated rows count and are told each; if no language has a model all is "none".

    The query learns from the column that it then takes for the declaration: its models are of what most declarations say, which is why a
    single wrong one is overruled by its text. Held-out accuracy is tested without declarations.
    """
    k = len(langs) + 1
    scored = stored(score_texts(rows, langs, logs, markup), "language")
    prior = [(1 - NONE_PRIOR) / len(langs)] * len(langs) + [NONE_PRIOR] if langs else [1.0]
    by_text = F.transform(F.arrays_zip(F.col("ll").alias("a"), F.array(*[F.lit(float(np.log(p))) for p in prior]).alias("b")),
        lambda v: v["a"] * TEMPER + v["b"])
    scored = scored.withColumn("text_lang", _best(by_text, langs))
    # Addresses: host, its last two labels, its last label.
    scored = scored.withColumns({"_domain": F.substring_index("_host", ".", -2), "_suffix": F.substring_index("_host", ".", -1)})

    hits = [F.sum((F.col("text_lang") == x).cast("double")).alias(f"n{j}") for j, x in enumerate([*langs, NONE])]
    every = scored.agg(*hits).first()
    total = [float(every[f"n{j}"] or 0) for j in range(k)]
    root = [(n + PRIOR_WEIGHT * p) / (sum(total) + PRIOR_WEIGHT) for n, p in zip(total, prior, strict=True)]
    hosts = scored.groupBy("_host", "_domain", "_suffix").agg(*hits)

    def level(counts: DataFrame, above: DataFrame | None, keys: list[str], up: str | None) -> DataFrame:
        n = F.array(*[F.col(f"n{j}") for j in range(k)])
        whole = sum((F.col(f"n{j}") for j in range(1, k)), F.col("n0"))
        if above is None:
            base = F.array(*[F.lit(p) for p in root])
            joined = counts.withColumn("_base", base)
        else:
            joined = counts.join(above.select(up, F.col("prior").alias("_base")), up)
        return joined.select(*keys, F.transform(F.arrays_zip(n.alias("a"), F.col("_base").alias("b")),
            lambda v: (v["a"] + PRIOR_WEIGHT * v["b"]) / (whole + PRIOR_WEIGHT)).alias("prior"))

    sums = [F.sum(f"n{j}").alias(f"n{j}") for j in range(k)]
    suffixes = level(hosts.groupBy("_suffix").agg(*sums), None, ["_suffix"], None)
    domains = level(hosts.groupBy("_domain", "_suffix").agg(*sums), suffixes, ["_domain"], "_suffix")
    priors = level(hosts, domains, ["_host"], "_domain")

    # P(declared | language), for declarations of known languages: at most languages squared rows.
    seen = {(r["d"], r["t"]): r["n"] for r in scored.where(F.col("_declared").isin(langs)).groupBy(F.col("_declared").alias("d"),
        F.col("text_lang").alias("t")).agg(F.count("*").alias("n")).collect()} if langs else {}
    table = []
    for t in [*langs, NONE]:
        whole = sum(seen.get((d, t), 0) for d in langs) + DECLARED_SMOOTH * len(langs)
        table.append({d: float(np.log((seen.get((d, t), 0) + DECLARED_SMOOTH) / whole)) for d in langs})
    known = F.from_json(F.lit(json.dumps({d: [row[d] for row in table] for d in langs})), "map<string,array<double>>")
    declared = F.coalesce(F.try_element_at(known, F.col("_declared")), F.array(*[F.lit(0.0)] * k))
    out = scored.join(priors, "_host", "left")
    fused = F.transform(F.arrays_zip(F.col("ll").alias("a"), declared.alias("b"), F.col("prior").alias("c")),
        lambda v: v["a"] * TEMPER + v["b"] + F.log(v["c"]))
    out = out.withColumn("_post", fused)
    weight = F.aggregate(F.transform("_post", lambda v: F.exp(v - F.array_max("_post"))), F.lit(0.0), lambda a, v: a + v)
    out = out.withColumns({"lang": _best(F.col("_post"), langs), "confidence": 1 / weight})
    unmodelled = F.lit(bool(langs)) & (F.col("lang") == NONE) & F.col("_declared").isNotNull() & ~F.coalesce(F.col("_declared").isin(langs), F.lit(False))
    out = out.withColumn("_other", unmodelled)
    return out.withColumns({
        "lang": F.when(F.col("_other"), F.col("_declared")).otherwise(F.col("lang")), "confidence": F.when(~F.col("_other"), F.col("confidence")),
        "accepted": F.col("_other") | ((F.col("lang") != NONE) & (F.col("confidence") >= ACCEPT))}).drop("_other", "ll", "prior",
        "_post", "_domain", "_suffix")


def identify_documents(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Languages of documents: their lang column is the declaration, their source the host. Learns from them if no model is given."""
    langs, logs = model or train(docs)
    rows = docs.select(*(keep or ["doc_id"]), normal(F.col("lang")).alias("_declared"), F.coalesce("source", F.lit("")).alias("_host"),
        F.coalesce("text", F.lit("")).alias("_text"))
    return identify(rows, langs, logs)


def identify_pages(pages: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Languages of web pages: declared by the html element's lang, hosts by url."""
    rows = pages.select(
        "page_id", normal(F.nullif(F.regexp_extract("html", _LANG, 1), F.lit(""))).alias("_declared"), host_of(F.col("url")).alias("_host"),
        F.coalesce("html", F.lit("")).alias("_text"))
    return identify(rows, *model, markup=True)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and every page (doc_id or page_id is null): host, declared, text_lang, lang, confidence, accepted."""
    docs, pages = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = train(docs)
    both = identify_documents(docs, model).unionByName(identify_pages(pages, model), allowMissingColumns=True)
    return both.select("doc_id", "page_id", F.col("_host").alias("host"), F.col("_declared").alias("declared"), "text_lang", "lang",
        F.round("confidence", 9).alias("confidence"), "accepted")
