"""Near duplicates by one-permutation hashing.

A document's set is its distinct word shingles as 64-bit hashes. One hash per shingle fills 256 bins with the smallest
hash of each; empty bins borrow from a bin drawn uniformly among the filled ones (optimal densification). Bins are
banded; documents with an equal band share a bucket. Band height is the largest at which a pair just at the threshold is
missed by all bands with a chance under 1e-5. Equal sets are one node from the start.

Candidates are star-shaped and confirmed on full sets. First, one edge a node, to the smallest member of one of its
buckets. Then rounds of stars: buckets that hold several components each draw one member, and the others of other
components are tested with it; what is confirmed is contracted before the next round, and buckets of one component
drop out. A round makes one candidate at most for a member of a bucket; rounds end when one confirms nothing.

What stars leave is found exactly: nodes of buckets that still hold several components meet by the rare shingles of
their full sets (a prefix filter), which misses no pair at the threshold. Among many documents of one template that lie
just under the threshold this last step tests most pairs; there are no caps. Confirmed edges go through connected
components.

Skew: exact copies collapse by (input partition, fingerprint) first, then by fingerprint; buckets are aggregated
before any shuffle and joined (a join whose large partitions adaptive execution splits), never gathered.

Defined results:
    null text, no words      empty set, linked with nothing, a component of its own
    fewer words than a shingle   the whole sequence is the one shingle
    very long texts          whole; a set is linear in its text
    null identifier          never linked: component_id null, kept
    rows with equal ids      one node, linked if any of their sets is
    ties                     the smallest identifier stays
    empty table              empty result
    further columns          ignored
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import counted, materialise, mix64

BINS = 256
ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) > 500_000:
            self.clear()
        self[word] = h
        return h


def shingles(text: str | None, width: int, known: WordHash) -> np.ndarray:
    """Sorted distinct shingle hashes. Words: runs without ASCII white space, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    k = min(width, n)
    acc = mix64(h[: n - k + 1])
    for j in range(1, k):
        acc = mix64(acc * ODD + h[j : n - k + 1 + j])
    return np.unique(acc)


def donors(seed: int = 1) -> np.ndarray:
    """For each bin an order of all bins in which it looks for a filled one."""
    return np.random.default_rng(seed).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)


def signature(s: np.ndarray, look: np.ndarray) -> np.ndarray:
    """Smallest hash in each bin of a sorted, non-empty set; empty bins borrow."""
    starts = np.searchsorted(s, np.arange(BINS, dtype=np.uint64) << np.uint64(56))
    ends = np.append(starts[1:], len(s))
    filled = ends > starts
    out = s[np.minimum(starts, len(s) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        first = filled[look[empty]].argmax(1)
        out[empty] = out[look[empty, first]]
    return out


def height(percent: int, miss: float = 1e-5) -> int:
    t = percent / 100
    return max([r for r in range(1, 33) if (1 - t**r) ** (BINS // r) < miss], default=1)


def band_keys(sigs: np.ndarray, rows: int) -> np.ndarray:
    """Documents x bands."""
    bands = BINS // rows
    cut = sigs[:, : bands * rows].reshape(len(sigs), bands, rows)
    acc = np.broadcast_to(np.arange(bands, dtype=np.uint64), cut.shape[:2])
    for j in range(rows):
        acc = mix64(acc * ODD + cut[:, :, j])
    return acc


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, rows: int) -> DataFrame:
    """doc_id, n (set size), f1, f2 (fingerprint of the set), keys (band keys, null for an empty set)."""

    def run(batches):
        import xxhash

        known, look, bands = WordHash(), donors(), BINS // rows
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sets = [shingles(x.as_py(), width, known) for x in part.column(1)]
                prints = np.array([(p >> 64, p & (2**64 - 1)) for p in (xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets)], np.uint64).view(np.int64)
                some = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if some:
                    for i, row in zip(some, band_keys(np.stack([signature(sets[i], look) for i in some]), rows), strict=True):
                        keys[i] = row.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n", "f1", "f2", "keys"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n long, f1 long, f2 long, keys array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text -> node, members (the sorted set)."""

    def run(batches):
        known = WordHash()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(x.as_py(), width, known).view(np.int64) for x in part.column(1)], pa.list_(pa.int64()))], ["node", "members"])

    return docs.mapInArrow(run, "node long, members array<long>")


def shared_rows(nodes: DataFrame) -> DataFrame:
    """nodes: node, n, keys. A row for each node and bucket of two or more: node, n, key."""
    rows = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = materialise(rows.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"))
    return rows.join(shared.hint("merge"), "key")


def first_edges(met: DataFrame, percent: int) -> DataFrame:
    """One candidate u > v for each node at most: of the smallest nodes of its buckets the one it shares most of them with
    (then the smallest), if its size allows."""
    hub = met.groupBy("key").agg(F.min(F.struct(F.col("node").alias("v"), F.col("n").alias("hub_n"))).alias("h")).select("key", "h.*")
    rays = met.select("node", "n", "key").join(materialise(hub).hint("merge"), "key")
    fit = (F.col("node") != F.col("v")) & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    often = rays.where(fit).groupBy(F.col("node").alias("u"), "v").agg(F.count("*").alias("c"))
    return often.groupBy("u").agg(F.min(F.struct(-F.col("c"), "v")).alias("m")).select("u", "m.v")


def with_parts(met: DataFrame, parts: DataFrame) -> DataFrame:
    """met's rows of buckets that hold several components: node, n, key, comp. parts: node, comp (a node without is its own)."""
    rows = met.select("node", "n", "key").join(parts.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    return rows.join(mixed.hint("merge"), "key", "left_semi").select("node", "n", "key", "comp")


def star(rows: DataFrame, percent: int, salt: int) -> DataFrame:
    """rows: node, n, key, comp. Candidates u > v between components: each bucket's members with one of them, drawn by salt; one
    row at most for a member of a bucket. Pairs whose sizes rule out the threshold go."""
    mark = F.xxhash64("key", F.lit(salt))
    hub = rows.groupBy("key").agg(F.min(F.struct(F.col("node").bitwiseXOR(mark).alias("m"), F.col("node").alias("v"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"))).alias("h"))
    rays = rows.join(materialise(hub.select("key", "h.v", "h.hub_n", "h.hub_comp")).hint("merge"), "key")
    fit = (F.col("comp") != F.col("hub_comp")) & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    return rays.where(fit).select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")).distinct()


def unsettled(met: DataFrame, parts: DataFrame) -> DataFrame:
    """node, comp: members of buckets that hold several components."""
    return with_parts(met, parts).select("node", "comp").distinct()


def prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int, step: float = 1.01) -> DataFrame:
    """Candidates u > v between components of nodes (node, comp): every pair that can reach the threshold.

    Such sets share at least percent / (100 + percent) of the sum of their sizes; so in one order of all shingles, rare
    ones first, they share one among the first of each, up to what it has beyond that and one more. Sizes are dealt into
    classes, so that the bound is near that of the pair's own sizes. Shingles of one node alone come first and meet
    nothing."""
    each = sets.join(nodes.hint("merge"), "node").select("node", "comp", F.size("members").alias("n"), F.explode("members").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    shared = each.join(often.hint("merge"), "s").groupBy("node", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("m"))
    class_of = lambda n: F.floor(F.log(n) / F.log(F.lit(step))).cast("int")
    size_of = lambda c: F.pow(F.lit(step), c.cast("double") - 1e-6)
    beyond = lambda c: F.col("n") - F.ceil(percent * (F.col("n") + size_of(c)) / (100 + percent) - 1e-6)
    others = F.sequence(class_of(F.col("n") * percent / 100) - 1, class_of(F.col("n") * 100 / percent) + 1)
    sized = shared.withColumn("own", class_of(F.col("n"))).withColumn("others", others)
    dealt = sized.select("node", "comp", "n", "own", (F.col("n") - F.size("m")).alias("ahead"), "m", F.explode("others").alias("other"))
    first = F.slice("m", F.lit(1), F.greatest(F.lit(0), beyond(F.col("other")) + 1 - F.col("ahead")).cast("int"))
    keyed = materialise(dealt.select("node", "comp", "n", "own", "other", F.explode(F.transform(first, lambda x: x["s"])).alias("s")))
    a = keyed.select(F.col("node").alias("u"), F.col("comp").alias("a"), F.col("n").alias("p"), "own", "other", "s")
    b = keyed.select(F.col("node").alias("v"), F.col("comp").alias("b"), F.col("n").alias("q"), F.col("own").alias("other"), F.col("other").alias("own"), "s")
    met = a.join(b.hint("merge"), ["s", "own", "other"])
    return met.where((F.col("u") > F.col("v")) & (F.col("a") != F.col("b")) & (100 * F.least("p", "q") >= percent * F.greatest("p", "q"))).select("u", "v").distinct()


def rows_of(docs: DataFrame, ids: DataFrame, most: int = 500_000) -> DataFrame:
    """docs' rows with a doc_id in ids (distinct). Up to `most` ids go to every executor; with more, both sides are dealt
    by doc_id."""
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids.hint("merge"), "doc_id", "left_semi")


def confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges whose sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("node").alias("v"), F.col("members").alias("a"))
    b = sets.select(F.col("node").alias("u"), F.col("members").alias("b"))
    both = edges.hint("merge").join(a, "v").hint("merge").join(b, "u")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(100 * shared >= percent * (F.size("a") + F.size("b") - shared)).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, stars: int = 1) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept. stars: rounds of stars at most; what they leave is for
    the prefix filter."""
    rows = height(percent)
    made = materialise(sketches(docs, id_col, text_col, width, rows).withColumn("origin", F.spark_partition_id()))
    full = made.where("n > 0 AND doc_id IS NOT NULL")
    runs = full.groupBy("origin", "f1", "f2").agg(F.min("doc_id").alias("least"))
    reps = runs.groupBy("f1", "f2").agg(F.min("least").alias("rep"))
    back = runs.select("origin", "f1", "f2").join(reps, ["f1", "f2"])
    members = materialise(full.join(back, ["origin", "f1", "f2"]).select("doc_id", "n", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("keys")).alias("keys")))
    nodes = members.where("doc_id = rep").select(F.col("rep").alias("node"), "n", "keys")
    met = materialise(shared_rows(nodes))
    ends = materialise(met.select(F.col("node").alias("doc_id")).distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = materialise(full_sets(rows_of(texts, ends), width))
    tested = materialise(first_edges(met, percent))
    found = materialise(confirm(tested, sets, percent))
    parts = materialise(components(found))
    for salt in range(stars):
        asked = materialise(star(materialise(with_parts(met, parts)), percent, salt).join(tested.hint("merge"), ["u", "v"], "left_anti"))
        more, n = counted(confirm(asked, sets, percent))
        tested = tested.union(asked)
        if not n:
            break
        found = found.union(more)
        parts = materialise(components(found))
    crowd, n = counted(unsettled(met, parts))
    if n:
        found = found.union(materialise(confirm(prefix_pairs(crowd, sets, percent), sets, percent)))
    linked = materialise(components(found))
    whole = members.select("doc_id", "n", "rep").join(linked.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    alone = made.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = whole.select("doc_id", "n", F.coalesce("comp", "rep").alias("component_id")).union(alone)
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_least(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: those with the smallest identifier of each component, and rows without an identifier.

    An identifier names a document: rows that repeat one stay or go together (exact_dedup.keep_first leaves one of those
    with equal texts)."""
    kept = near_duplicates(docs, id_col, text_col, width, percent).where("kept").select(F.col(id_col).alias("kept_id"))
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["kept_id"]), "left_semi")
