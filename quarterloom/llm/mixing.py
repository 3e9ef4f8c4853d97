"""Mixing sources to target weights by soft membership.

One pass over the texts counts the tokens of every document with a label. A classifier (naive Bayes
over hashed words, fitted on all documents whose label names a domain, the weight of the words calibrated
on a fifth of them that is held out) gives every document a membership in the domains of the target table:
certain for documents whose label, however spelled, names a domain, the posterior for documents without
a label, which are read once more for it. Nonnegative document rates, at most the domain's number of
repeats, are fitted by projected-gradient least squares so that the expected tokens of every domain
meet its target. Documents of one label have the same membership and thus one rate, so they enter with
their sum of tokens; for those without a label a round ends with one residual per domain, and a
document's rate is the replay of the residuals since the rates were last written, so that a round is one
pass over a compact table (tokens, memberships, rates) that returns one number per domain. The steps have
momentum, which starts anew where it leads uphill, and go on until the fit stands still.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterloom.llm.bpe import DEFAULT_PATH, Encoder, broadcast_vocabulary, pieces
from quarterloom.session import discard, ship, written

#: Hash buckets of words in the classifier; its table has domains x BUCKETS counts.
BUCKETS = 8192
#: The fit ends once a plain step moves no domain's expected tokens by more than this share of all.
TOLERANCE = 1e-9
#: Rounds whose steps are replayed, before the rates are written.
REPLAY = 20
SLICES = 4096
#: Documents whose words' evidence is added up at once.
DOCUMENTS = 500
#: Weights of the words' evidence that are tried.
TRUSTS = (0.0, 0.01, 0.03, 0.1, 0.3, 1.0)


def source_key(c: Column | str) -> Column:
    """A source's name in lower case, with blanks and hyphens as underscores. NULL if empty."""
    bare = F.regexp_replace(F.lower(F.trim(F.col(c) if isinstance(c, str) else c)), r"[\s-]+", "_")
    return F.when(bare != "", bare)


@dataclass
class Mix:
    """documents: doc_id, source, n_tokens, rate, copies. report: one row per source of the targets.
    trust: the weight of the classifier's words."""

    documents: DataFrame
    report: DataFrame
    trust: float


class Words:
    """Texts to their buckets of words; keeps the buckets of words seen before."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def buckets(self, text: str) -> np.ndarray:
        words = set(text.lower().split())
        if len(self.known) > 300_000:
            self.known.clear()
        for w in [w for w in words if w not in self.known]:  # words - known.keys() would go over all known ones
            self.known[w] = -1 if any(ch.isdigit() for ch in w) else zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS
        return np.unique([b for b in map(self.known.__getitem__, words) if b >= 0]).astype(np.int64)


def labelled_sample(docs: DataFrame, counts: dict[str, int], size: int | None = None) -> DataFrame:
    """(label, held, buckets) of all documents of the labels in ``counts``, copies of a text counting once, written.
    ``docs``: doc_id, label, text. A fifth of the texts is held out, by hash. With ``size`` only about so many, the same
    number of each label (all of one that has fewer), chosen by a hash of id and text; the mix sets none."""
    ship(docs.sparkSession)
    some = docs.filter(F.col("label").isin([d for d, n in counts.items() if n]))
    if size is not None:
        per = size / max(len(counts), 1)
        share = F.coalesce(*[F.when(F.col("label") == d, F.lit(min(1.0, per / n))) for d, n in counts.items() if n], F.lit(0.0))
        some = some.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share)
    some = some.groupBy("label", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            at = 0
            for piece in pieces(b.column(2)):
                each = [words.buckets(t) for t in piece]
                ends = np.cumsum([0, *map(len, each)], dtype=np.int32)
                got = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(piece)), b.column(1).slice(at, len(piece)), got], ["label", "held", "buckets"])
                at += len(piece)

    return written(some.select("label", (F.pmod("h", F.lit(5)) == 0).alias("held"), "text").mapInArrow(run, "label string, held boolean, buckets array<long>"), "sample")


def _flat(b: pa.RecordBatch, domains: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch with label first and buckets last: the number of each document's domain (-1: none), all buckets in
    one array, and how many each document has."""
    of_doc = pc.fill_null(pc.index_in(b.column(0), pa.array(domains, b.column(0).type)), -1).to_numpy().astype(np.int64)
    lists = b.column(b.num_columns - 1)
    return of_doc, lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)


def word_counts(sample: DataFrame, domains: list[str]) -> np.ndarray:
    """Per fold (kept, held out) and domain: documents per word bucket, and in the last column all of them."""
    k = len(domains)
    total = np.zeros((2, k, BUCKETS + 1))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2 * k * (BUCKETS + 1), np.int64)
        for b in batches:
            of_doc, buckets, sizes = _flat(b, domains)
            row = (b.column(1).to_numpy(zero_copy_only=False) * k + of_doc) * (BUCKETS + 1)
            row[of_doc < 0] = -1
            cells = np.repeat(row, sizes)
            n += np.bincount((cells + buckets)[cells >= 0], minlength=len(n)) + np.bincount(row[row >= 0] + BUCKETS, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["cell", "n"])

    cells = sample.select("label", "held", "buckets").mapInArrow(add, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for r in cells.collect():  # at most 2 * k * (BUCKETS + 1) rows
        total.flat[r["cell"]] = r["n"]
    return total


def posterior_model(counts: np.ndarray, trust: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each bucket per domain (words that a document lacks say nothing, as documents
    differ in length) times ``trust``, and each domain's log share of documents."""
    words, n = counts[:, :-1] + 0.1, counts[:, -1]
    return trust * np.log(words / words.sum(axis=1, keepdims=True)), np.log((n + 0.5) / (n.sum() + 0.5 * len(n)))


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def posterior(model: tuple[np.ndarray, np.ndarray], buckets: np.ndarray) -> np.ndarray:
    word, base = model
    return _softmax(base + word[:, buckets].sum(axis=1))


def calibrated_trust(sample: DataFrame, domains: list[str], kept: np.ndarray) -> float:
    """Of TRUSTS the weight of the words with the least log loss on the held-out documents, by a model of
    the others: 0, which leaves the domains' shares, if words tell nothing about the domain.

    The evidence of a document's words is added up once; every weight only scales it."""
    model, trusts = sample.sparkSession.sparkContext.broadcast(posterior_model(kept)), np.array(TRUSTS)

    def loss(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros(len(trusts))
        word, base = model.value
        for whole in batches:
            for b in (whole.slice(at, DOCUMENTS) for at in range(0, whole.num_rows, DOCUMENTS)):
                of_doc, buckets, sizes = _flat(b, domains)
                sums = np.concatenate([np.zeros((1, len(domains))), np.cumsum(word.T[buckets], axis=0)])
                ends = np.cumsum(sizes)
                evidence = (sums[ends] - sums[ends - sizes])[of_doc >= 0]
                at = np.arange(len(evidence)), of_doc[of_doc >= 0]
                for i, trust in enumerate(trusts):
                    s[i] -= np.log(np.maximum(_softmax(base + trust * evidence)[at], 1e-300)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s))), pa.array(s)], ["i", "s"])

    got = sample.filter("held").select("label", "buckets").mapInArrow(loss, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    return TRUSTS[min(got, key=lambda r: (r["s"], r["i"]))["i"]] if got else TRUSTS[0]


def mix_sources(
    docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str = DEFAULT_PATH, seed: int = 0
) -> Mix:
    """Fits the mix of ``docs`` to ``targets`` (source, target_share, max_repeats; one row per source,
    a small table by its nature, which the driver reads).

    Total size: the tokens of all documents with a source of ``targets``. Documents of other named
    sources take no part; those without a name take part by their posterior, with the repeats of
    their likeliest domain. A source that cannot reach its share is used in full, max_repeats times;
    the others still get their tokens. ``copies`` rounds ``rate`` up or down by a hash of the id, so
    that the size of each source is kept and no document exceeds its repeats. All documents of the
    targets' sources take part in the fit of the classifier.

    report: source (as in ``targets``), n_documents, n_tokens, target_share, max_repeats,
    target_tokens, expected_tokens, mixed_tokens (of copies), reached_share, short (its tokens times
    max_repeats are fewer than its target). NULL and empty texts have no tokens; equal ids are
    rounded alike; with no documents every share is 0 and no source is short.
    """
    spark = docs.sparkSession
    rows = targets.withColumn("__k", source_key("source")).orderBy("__k").collect()
    domains = [r["__k"] for r in rows]
    share = np.array([float(r["target_share"]) for r in rows])
    repeats = np.array([float(r["max_repeats"]) for r in rows])
    k, index = len(domains), {d: i for i, d in enumerate(domains)}
    kind = docs.schema[doc_id].dataType
    base = docs.select(F.col(doc_id).alias("doc_id"), source_key(source).alias("label"), F.col(text).alias("text"))
    vocabulary = broadcast_vocabulary(spark, path)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for b in batches:
            at = 0
            for piece in pieces(b.column(2)):
                n = pa.array([len(ids) for ids in encoder.encode(piece)], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(piece)), b.column(1).slice(at, len(piece)), n], ["doc_id", "label", "n_tokens"])
                at += len(piece)

    sized = T.StructType([T.StructField("doc_id", kind), T.StructField("label", T.StringType()), T.StructField("n_tokens", T.LongType())])
    named = written(base.filter(F.col("label").isNotNull()).mapInArrow(measure, sized), "sizes")
    exact = {r["label"]: r for r in named.filter(F.col("label").isin(domains)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()}
    tokens = np.array([float(exact[d]["t"]) if d in exact else 0.0 for d in domains])
    total = tokens.sum()
    goal = share * total

    nameless = base.filter(F.col("label").isNull())
    trust, word, of_all = TRUSTS[0], np.zeros((k, BUCKETS)), np.zeros(k)
    if exact:
        known = labelled_sample(base, {d: int(r["n"]) for d, r in exact.items()})
        folds = word_counts(known, domains)
        trust = calibrated_trust(known, domains, folds[0])
        # the texts, each once, give the words of each domain; the domains' shares are those of all documents
        word, of_all = posterior_model(folds.sum(axis=0), trust)[0], np.log([(float(exact[d]["n"]) if d in exact else 0.0) + 0.5 for d in domains])
    model = spark.sparkContext.broadcast((word, of_all))

    real = T.DoubleType()
    fields = T.StructType([sized[0], sized[2], T.StructField("cap", real), T.StructField("member", T.ArrayType(real)), T.StructField("rate", real), T.StructField("before", real)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, words = Encoder(vocabulary.value), Words()
        for b in batches:
            at = 0
            for piece in pieces(b.column(1)):
                n = pa.array([len(ids) for ids in encoder.encode(piece)], pa.int64())
                m = np.array([posterior(model.value, words.buckets(t)) for t in piece]).reshape(-1, k)
                member = pa.ListArray.from_arrays(pa.array(np.arange(len(piece) + 1, dtype=np.int32) * k), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(piece)), n, pa.array(cap := repeats[m.argmax(axis=1)]), member, *[pa.array(np.minimum(1.0, cap))] * 2], fields.names)
                at += len(piece)

    soft = written(nameless.select("doc_id", "text").mapInArrow(judge, fields), "memberships") if k else None
    any_soft = soft is not None and not soft.isEmpty()

    def replay(b: pa.RecordBatch, steps: list[tuple[float, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, memberships, rates and those of the round before: every step goes on as the last one did, by its
        momentum, and down the gradient, then back into the box."""
        t, cap, rate, before = (b.column(b.schema.get_field_index(c)).to_numpy().astype(float) for c in ("n_tokens", "cap", "rate", "before"))
        m = b.column(b.schema.get_field_index("member")).flatten().to_numpy().reshape(-1, k)
        for beta, g in steps:
            rate, before = np.clip(rate + beta * (rate - before) - m @ g, 0.0, cap), rate
        return t, m, rate, before

    def soft_sums(steps: list[tuple[float, np.ndarray]] | None) -> np.ndarray:
        """Expected tokens of the documents without a label per domain, at their rates or, without steps, at rate 1."""
        if not any_soft:
            return np.zeros(k)

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = np.zeros(k)
            for b in batches:
                t, m, rate, _ = replay(b, steps or [])
                s += (t * rate if steps is not None else t) @ m
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(s)], ["i", "s"])

        got = np.zeros(k)
        for r in soft.select("n_tokens", "member", "cap", "rate", "before").mapInArrow(gather, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
            got[r["i"]] = r["s"]
        return got

    mass = tokens + soft_sums(None)
    scale = np.where(mass > 0, mass, 1.0)
    steps: list[tuple[float, np.ndarray]] = []

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, rate, before = replay(b, steps)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(rate), pa.array(before)], fields.names)

    rate = before = np.minimum(1.0, repeats)  # of each label's documents
    expected = last = tokens * rate + soft_sums([])
    age = 0  # rounds since the momentum started
    while True:
        beta = age / (age + 3)
        g = (expected + beta * (expected - last) - goal) / scale  # expected tokens are linear in the rates
        steps.append((beta, g))
        rate, before = np.clip(rate + beta * (rate - before) - g, 0.0, repeats), rate
        expected, last = tokens * rate + soft_sums(steps), expected
        still = np.abs(expected - last).max(initial=0.0) <= TOLERANCE * max(mass.sum(), 1.0)
        if still and beta == 0:
            break
        age = 0 if still or g @ (expected - last) > 0 else age + 1
        if any_soft and len(steps) == REPLAY:
            old, soft = soft, written(soft.mapInArrow(advance, fields), "memberships")
            discard(old)
            steps = []

    out = T.StructType([sized[0], sized[2], T.StructField("rate", T.DoubleType())])

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(replay(b, steps)[2])], ["doc_id", "n_tokens", "rate"])

    # Whole copies: a hash of the id gives every document a place in [0, 1). Documents of one label
    # have one rate; which of them get a further copy is cut so that their tokens meet what the rate
    # gives, from the tokens of each slice of places (domains x SLICES numbers).
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    slices = np.zeros((k, SLICES))
    placed = named.filter(F.col("label").isin(domains)).groupBy("label", F.floor(place * SLICES).alias("s")).agg(F.sum("n_tokens").alias("t"))
    for r in placed.collect():
        slices[index[r["label"]], int(r["s"])] = r["t"]
    cut = np.zeros(k)
    for i in range(k):
        upto = np.concatenate([[0.0], np.cumsum(slices[i])])
        cut[i] = np.abs(upto - (rate[i] - np.floor(rate[i])) * tokens[i]).argmin() / SLICES
    of_label = lambda v: F.coalesce(*[F.when(F.col("label") == d, F.lit(float(v[i]))) for i, d in enumerate(domains)], F.lit(0.0))
    mixed = named.select("doc_id", F.col("label").alias("source"), "n_tokens", of_label(rate).alias("rate"), of_label(cut).alias("edge"))
    if any_soft:
        more = soft.mapInArrow(rates, out)
        mixed = mixed.unionByName(more.select("doc_id", F.lit(None).cast("string").alias("source"), "n_tokens", "rate", (F.col("rate") - F.floor("rate")).alias("edge")))
    copies = (F.floor("rate") + F.when(place < F.col("edge"), 1).otherwise(0)).cast("int")
    mixed = mixed.withColumn("copies", copies).drop("edge")
    used = {r["source"]: float(r["t"] or 0) for r in mixed.filter((F.col("copies") > 0) & F.col("source").isin(domains)).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()}
    size = sum(used.values())
    lines = []
    for i, r in enumerate(rows):
        d = domains[i]
        full = tokens[i] == 0 or expected[i] >= tokens[i] * repeats[i] * (1 - 1e-9)  # its documents are used to the full
        short = bool(full and tokens[i] * repeats[i] < goal[i])
        got = used.get(d, 0.0)
        lines.append((r["source"], int(exact[d]["n"]) if d in exact else 0, int(tokens[i]), float(share[i]), int(repeats[i]), float(goal[i]), float(expected[i]), int(got), got / size if size else 0.0, short))
    report = spark.createDataFrame(
        lines,
        "source string, n_documents long, n_tokens long, target_share double, max_repeats int, target_tokens double, expected_tokens double, mixed_tokens long, reached_share double, short boolean",
    )
    return Mix(mixed.withColumnRenamed("doc_id", doc_id), report, trust)
