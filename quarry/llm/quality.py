"""Host-level quality rules: failures by host, shrunk by an empirical beta prior.

Every document is measured by rules.  For each soft rule the failures of a host (the
``source``) are summed by grouped aggregation; a beta prior is fitted to the hosts'
rates by the method of moments, and each host's rate is shrunk towards it.  A host whose
shrunk rate is clearly above the corpus rate is strict for that rule; its verdicts are
joined back, and a document goes if it fails a rule for which its host is strict.  A
document that fails no rule always stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, with_small

#: Soft rules over the measured columns.
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
    "repeats": "100 * n_repeat_words > 20 * n_words",
}
#: A host is strict for a rule above this multiple of the corpus rate, and above this rate.
EXCESS, LEAST_RATE = 2.0, 0.1
SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
BLOCK_CHARS = 4_000_000


def _repeated_words(codes: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more; ``codes`` number equal words equally."""
    n = len(codes)
    if n < 4:
        return 0
    pair = np.unique(codes[:-1] * (int(codes.max()) + 1) + codes[1:], return_inverse=True)[1]
    windows, counts = np.unique(pair[:-1] * n + codes[2:], return_inverse=True, return_counts=True)[1:]
    twice = counts[windows] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def _measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    codes = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    repeated = _repeated_words(codes) if len(seen) < len(words) else 0
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of whole texts.

    Null and empty texts have no words.  Words are runs without ASCII white space;
    lines count when they hold a word.  No shuffle.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices([len(t or "") for t in texts], BLOCK_CHARS):
                values = np.array([_measure(t) for t in texts[a:b]], np.int64).reshape(-1, len(names))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("source").cast(pa.string()), *(pa.array(values[:, k]) for k in range(len(names)))], names=["doc_id", "source", *names])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, " + ", ".join(f"{n} long" for n in names))


def host_verdicts(facts: DataFrame) -> DataFrame:
    """One row a host: its documents, and for each soft rule the shrunk rate and whether it is strict.

    ``facts`` has a column ``host`` and a boolean column ``fails_<rule>`` for each rule.
    Hosts' rates have mean m and variance v (each host counts once); the prior is
    beta(m k, (1 - m) k) with k = m (1 - m) / v - 1, held within 1 and 1000.
    """
    hosts = stored(facts.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *(F.sum(F.col(f"fails_{r}").cast("long")).alias(r) for r in RULES)))
    # one row: sums over hosts and over documents
    prior = hosts.agg(
        *(F.avg(F.col(r) / F.col("n_docs")).alias(f"m_{r}") for r in RULES),
        *(F.var_pop(F.col(r) / F.col("n_docs")).alias(f"v_{r}") for r in RULES),
        *((F.sum(r) / F.sum("n_docs")).alias(f"all_{r}") for r in RULES),
    )
    joined = hosts.join(F.broadcast(prior))
    out = [F.col("host"), F.col("n_docs")]
    for r in RULES:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        k = F.when(v > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), m * (1 - m) / v - 1))).otherwise(F.lit(1000.0))
        rate = (F.col(r) + m * k) / (F.col("n_docs") + k)
        out += [rate.alias(f"rate_{r}"), (rate > F.greatest(F.lit(LEAST_RATE), F.lit(EXCESS) * F.col(f"all_{r}"))).alias(f"strict_{r}")]
    return joined.select(*out)


def judge(docs: DataFrame) -> DataFrame:
    """Measures of every row with ``base_failed``, ``host_failed`` and ``kept``.

    Null sources are one host of their own (``host`` is ``null``, else ``=`` and the source); repeated rows count each; texts of any
    length are measured whole; an empty table gives an empty result; columns other than doc_id, text and source are ignored.
    """
    facts = measures(docs).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    facts = facts.withColumn("host", F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), "source")))
    for rule, failing in RULES.items():
        facts = facts.withColumn(f"fails_{rule}", F.expr(failing))
    facts = stored(facts)
    verdicts = stored(host_verdicts(facts))
    joined = with_small(facts, verdicts.select("host", *(f"strict_{r}" for r in RULES)), "host")
    host_failed = F.lit(False)
    for r in RULES:
        host_failed = host_failed | (F.col(f"fails_{r}") & F.col(f"strict_{r}"))
    return joined.withColumn("host_failed", host_failed).withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
