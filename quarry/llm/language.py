"""Language ID by Bayesian fusion of evidence.

Text likelihoods come from hashed character trigrams, a language declared in markup
from the likelihood of a right declaration, and the prior from the host: languages are counted
(as posteriors of text and markup) by host and by address suffix in grouped aggregations, and each
host's shares are smoothed towards its suffix's, these towards the corpus's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, fresh_worker, slices, stored, tidy, with_small

BUCKETS = 1 << 16
#: Distinct labelled rows that the trigram model is fitted on; it has their languages.
SAMPLE_DOCS = 4000
#: A declaration is right this often; the weight of the wider level in host shares.
DECLARED_RIGHT, SMOOTHING = 0.9, 20.0
#: Trigrams overlap, so their log-likelihood counts for a part, up to so many of them.
TEMPER, MOST_TRIGRAMS = 0.3, 300
#: Below these a document is rejected: the posterior, log-likelihood a trigram, trigrams.
LEAST_CONFIDENCE, LEAST_FIT, LEAST_TRIGRAMS = 0.6, -11.0, 3
BLOCK_CHARS = 500_000
MARKUP = r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})\b"


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every trigram around a letter, index of its text); other characters count as blanks."""
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")).to_pylist()
    lens = np.fromiter((len(t) + 2 for t in lowered), np.int64, len(lowered))
    code = np.frombuffer((" " + "  ".join(lowered) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
    code = np.where((code >= 0xC0) & (code != 0xD7) & (code != 0xF7) | (code >= 97) & (code <= 122), code, 32)
    at = np.flatnonzero(code[1:-1] != 32) + 1
    h = (code[at - 1] * 0x9E3779B1 + code[at] * 0x85EBCA77 + code[at + 1] * 0xC2B2AE3D) & 0xFFFFFFFF
    h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
    return (h >> 16).astype(np.int64), np.repeat(np.arange(len(lowered)), lens)[at]


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihoods [bucket, language]) from labelled rows.

    The sample is the first ``SAMPLE_DOCS`` distinct labelled rows in the order of a hash of all they say;
    whole texts are counted on the executors, and the table of buckets comes back.
    """
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("doc_id", "lang", "text").alias("h"))
    last = labelled.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]

    def count(batches):
        for batch in batches:
            names = batch.column("lang").to_pylist()
            distinct = sorted(set(names))
            which = np.array([distinct.index(x) for x in names], np.int64)
            for a, b in slices(pc.utf8_length(batch.column("text").cast(pa.string())).to_pylist(), BLOCK_CHARS):
                bucket, text = trigrams(batch.column("text").slice(a, b - a))
                keys, n = np.unique(which[a:b][text] * BUCKETS + bucket, return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([distinct[k] for k in keys // BUCKETS], pa.string()), "bucket": keys % BUCKETS, "n": n})

    sample = labelled.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"])  # no rows: the least hash is null
    counted = sample.select("lang", "text").mapInArrow(tidy(count), "lang string, bucket long, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("all"), F.collect_list(F.struct("bucket", "n")).alias("table")).collect()
    rows.sort(key=lambda r: r["lang"])
    counts = np.full((BUCKETS, max(1, len(rows))), 0.2)
    for k, r in enumerate(rows):
        for bucket, n in r["table"]:
            counts[bucket, k] += n
    return [r["lang"] for r in rows] or ["und"], np.log(counts / counts.sum(0)).astype(np.float32)


def scored(docs: DataFrame, likelihoods: np.ndarray) -> DataFrame:
    """``docs`` with ``_fit`` (tempered log-likelihood by language), ``_mean`` (of the best, a trigram), ``_n`` (trigrams)."""
    model = docs.sparkSession.sparkContext.broadcast(likelihoods)  # a float for each bucket and language of the sample

    def run(batches):
        fresh_worker()
        table = model.value
        for batch in batches:
            for a, b in slices(pc.fill_null(pc.utf8_length(batch.column("text").cast(pa.string())), 0).to_pylist(), BLOCK_CHARS):
                part = batch.slice(a, b - a)
                bucket, text = trigrams(part.column("text"))
                n = np.bincount(text, minlength=b - a)
                sums = np.stack([np.bincount(text, table[bucket, k], minlength=b - a) for k in range(table.shape[1])], 1)
                mean = sums / np.maximum(n, 1)[:, None]
                fit = mean * (TEMPER * np.minimum(n, MOST_TRIGRAMS))[:, None]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(fit), pa.list_(pa.float64())), pa.array(np.where(n > 0, mean.max(1), 0.0)), pa.array(n.astype(np.int64))], names=[*part.schema.names, "_fit", "_mean", "_n"])

    clean = docs.drop("_fit", "_mean", "_n")
    return clean.mapInArrow(tidy(run), ", ".join(f"`{n}` {t}" for n, t in clean.dtypes) + ", _fit array<double>, _mean double, _n long")


def shares(counts: DataFrame, n: int) -> DataFrame:
    """Hierarchically smoothed shares: (host, prior array) from (host, suffix, c0 .. c<n-1>), stored."""
    names = [f"c{k}" for k in range(n)]
    sums = [F.sum(c).alias(c) for c in names]
    vector = lambda: F.array(*names)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    smooth = lambda own, wide: F.zip_with(own, wide, lambda c, p: (c + F.lit(SMOOTHING) * p) / (total(own) + F.lit(SMOOTHING)))
    suffixes = stored(counts.groupBy("_suffix").agg(*sums).select("_suffix", vector().alias("s")))
    world = suffixes.agg(*(F.sum(F.col("s")[k]).alias(c) for k, c in enumerate(names))).select(F.transform(vector(), lambda c: (F.coalesce(c, F.lit(0.0)) + 1.0)).alias("w"))
    world = world.select(F.transform("w", lambda c: c / total(F.col("w"))).alias("w"))
    suffixes = stored(suffixes.join(F.broadcast(world)).select("_suffix", smooth(F.col("s"), F.col("w")).alias("s")))
    hosts = with_small(counts.select("_host", "_suffix", vector().alias("own")), suffixes, "_suffix")
    return stored(hosts.select("_host", smooth(F.col("own"), F.col("s")).alias("_prior")))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, host: str = "source") -> DataFrame:
    """``docs`` with ``language``, ``confidence`` (its posterior) and ``kept``.

    ``host`` names a column with a host or a URL; a null host is one host without suffix.
    Rejected are documents with hardly a letter, whose trigrams fit no language, or
    whose posterior is low.  Null and empty texts are rejected; texts of any length are scored whole; of languages with equal posteriors
    the first by name is taken; columns of these three
    names are replaced, all others stay as they are; repeated rows count each; an empty table stays empty.
    """
    docs = docs.drop("language", "confidence", "kept")
    columns = docs.columns
    docs, own = aside(docs, ["_fit", "_mean", "_n", "_host", "_declared", "_suffix", "_prior", "_post"])
    host = own.get(host, host)
    languages, likelihoods = model or train(docs)
    size = len(languages)
    address = F.lower(F.coalesce(F.regexp_extract(F.col(host), r"^(?:[a-zA-Z]+://)?(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))
    declared = F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), MARKUP, 1))
    known = F.array(*map(F.lit, languages))
    wrong = (1 - DECLARED_RIGHT) / max(1, size - 1)
    found = scored(docs, likelihoods).withColumns({"_host": address, "_declared": F.array_position(known, declared)})
    found = found.withColumn("_suffix", F.regexp_extract("_host", r"\.([a-z]+)$", 1))
    evidence = F.when(F.col("_declared") > 0, F.transform("_fit", lambda x, i: x + F.log(F.when(i + 1 == F.col("_declared"), DECLARED_RIGHT).otherwise(wrong + 1e-6)))).otherwise(F.col("_fit"))
    found = found.withColumn("_fit", evidence)

    def posterior(scores):
        powers = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
        return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))

    alone = found.where(f"_n >= {LEAST_TRIGRAMS}").select("_host", "_suffix", posterior(F.col("_fit")).alias("p"))
    counts = stored(alone.groupBy("_host", "_suffix").agg(*(F.sum(F.col("p")[k]).alias(f"c{k}") for k in range(size))))
    priors = shares(counts, size)
    joined = with_small(found, priors, "_host")
    fused = F.zip_with("_fit", F.coalesce("_prior", F.array(*[F.lit(1.0 / size)] * size)), lambda x, p: x + F.log(p))
    judged = joined.withColumn("_post", posterior(fused))
    best = F.array_max("_post")
    judged = judged.withColumns({"language": F.element_at(known, F.array_position("_post", best).cast("int")), "confidence": F.round(best, 4)})
    kept = (F.col("_n") >= LEAST_TRIGRAMS) & (F.col("_mean") >= LEAST_FIT) & (F.col("confidence") >= LEAST_CONFIDENCE)
    return judged.withColumn("kept", kept).select(*(F.col(own.get(c, c)).alias(c) for c in columns), "language", "confidence", "kept")
