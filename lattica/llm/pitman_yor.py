"""Language model scoring with a hierarchical Pitman-Yor process.

Tokens are words and one end mark a document. The root restaurant holds the vocabulary. Every word, and the end mark
before a document, has a context restaurant, which holds what follows it and sends one customer to the root, its parent,
for each of its tables. A dish with one customer has one table whatever is drawn, so only pairs (context, word) seen at
least twice are sampled; the others are counted as they are.

Tables are sampled by blocked Gibbs sweeps: all customers of a dish leave, and come back one after another by the
Chinese restaurant rule (beyond the first 48 in growing blocks, by the normal approximation of the binomial). The pairs
of one word are in one part, or, for words of a large share of all tokens, spread over the parts by their context. A
context's totals are kept at its home. Between outer rounds parts send homes the tables they have seated, and homes tell
each part what its contexts have in all; words that are spread get the sum of their root customers elsewhere.
Probabilities are averaged over the sweeps after burn-in. Random numbers come from a hash of (word, context, sweep,
step), so a task that runs again draws the same. Parts are as many as the session's shuffle partitions, and the draw depends
on their number (4 against 7 parts moved scores by up to 0.17 % on 200 documents). The root's base measure has one outcome for all unknown words, with
nearly all weight, as new tables of the root are new words.

Documents are read in blocks of bounded size, each stored as one row. A block asks once for each of its distinct words and
tells each part its distinct pairs; a part answers only for pairs that are not what the block takes them for (seen once
where the block itself has learned from it, else not at all). What parts, homes and blocks tell one another is packed:
sorted hashes and counts in a few bytes each. So neither the vocabulary nor a count table is ever gathered in one place;
the driver gets totals, and the counts of spread words (at most 8 x parts of them, in each part).

Words are known by 64-bit hashes; V words have a chance of V^2 / 2^65 that two share one.

Defined results:
    null text, empty text   the end mark alone
    very long texts         whole; a block ends behind the document that fills it
    null identifier         never learned from, held_out false, scored
    unknown words           one outcome, as in the base score
    nothing to learn from   base_score from c = N = V = 0; score from the base measure: log10 of 1 for each token
    repeated rows           each learned from and scored
    empty table             empty result
    further columns         ignored
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise, mix64, mod_crc, width

END = b" "  # no word holds a space
ODD = np.uint64(0x9E3779B97F4A7C15)
EXACT = 48  # customers that are seated singly
KNOWN_SHARE = 0.01  # of the root's base measure, for known words together


def words(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z), then the end mark."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def coded(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts (null: empty), the place of each word among them, and the number of words of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten().dictionary_encode()
    names, place = flat.dictionary.cast(pa.binary()).to_pylist(), flat.indices.to_numpy()
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    if b"" in names:  # stands where a text begins or ends with white space
        gone = place == names.index(b"")
        lengths = lengths - np.bincount(np.repeat(np.arange(len(lengths)), lengths)[gone], minlength=len(lengths))
        place = place[~gone]
    return names, place, lengths


def frequent(train: DataFrame, text_col: str, share: float) -> list[bytes]:
    """Words with about the share of all tokens or more; they only decide where pairs are counted. A task leaves out what
    has under a twentieth of it in its part."""

    def run(batches):
        found: Counter = Counter()
        n = 0
        for batch in batches:
            names, place, _ = coded(batch.column(0))
            n += len(place) + batch.num_rows
            for w, k in zip(names, np.bincount(place, minlength=len(names)).tolist(), strict=True):
                if k:
                    found[w] += k
            if len(found) > 250_000:
                found = Counter({w: k for w, k in found.items() if k >= n * share / 40})
        if n:
            kept = [(w, k) for w, k in found.items() if k >= n * share / 20]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept] + [None], pa.binary()), pa.array([k for _, k in kept] + [n], pa.int64())], ["word", "n"])

    rows = train.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = rows.where("word IS NULL").first()
    if total is None:
        return []
    return sorted(bytes(r["word"]) for r in rows.where(F.col("word").isNotNull() & (F.col("n") >= F.lit(share * total["n"]))).collect())


class Ids(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


BLOCKS = "block long, hashes array<long>, tokens binary, lengths binary, doc_ids array<long>, held array<boolean>, learned array<boolean>"
PAIRS = "part int, block long, words binary, runs binary, ctxs binary, ns binary, locals binary"
COUNTS = "kind int, part int, home int, key long, n long, singles long, idx long, block long, a binary, b binary, c binary, d binary, e binary"
HOMES = "home int, types long, keys binary, customers binary, singles binary"
TOLD = "kind int, part int, home int, key long, n long, x double, a binary, b binary"
DRAWS = "kind int, part int, home int, key long, x double, a binary, b binary"
ANSWERS = "block long, locals binary, nums binary"


def _table(schema: str, n: int, /, **columns) -> pa.Table:
    """A table of the schema; missing columns are null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(n, kinds[kind]) for name, kind in fields})


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers as their low halves, then their high halves (which compress well)."""
    return (x & 0xFFFF).astype("<u2").tobytes() + (x >> 16).astype("<u2").tobytes()


def _whole(b: bytes) -> np.ndarray:
    x = np.frombuffer(b, "<u2").astype(np.int64)
    half = len(x) // 2
    return x[:half] | (x[half:] << 16)


def pairs_of(tokens: np.ndarray, n_words: int):
    """Of a block's tokens (local numbers of words, 0 the end mark, whole documents): its distinct pairs, sorted, as
    word * n_words + context, and each token's pair."""
    key = tokens * n_words
    key[1:] += tokens[:-1]
    bits = len(tokens).bit_length()
    if (n_words * n_words).bit_length() + bits > 63:
        return np.unique(key, return_inverse=True)
    key <<= bits  # pair and place in one number: sorting numbers takes less time and memory than sorting places
    key |= np.arange(len(tokens))
    key.sort()
    place = (key & ((1 << bits) - 1)).astype(np.int32)
    key >>= bits
    first = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=first[1:])
    local = np.empty(len(key), np.int32)
    local[place] = np.cumsum(first, dtype=np.int32) - 1
    return key[first], local


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """A row for each block of documents: hashes of its distinct words (the end mark first), and its tokens as places among
    them, with the documents' lengths, identifiers, held_out and learned."""

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId() << 20, 0

        def fresh():
            ids = Ids()
            ids[END]
            return ids, [], [], [], [], [], 0

        def flush(ids, tokens, lengths, docs, held, learned, _):
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids)).view(np.int64)
            row = [[task + number], [hashes], [_planes(np.concatenate(tokens))], [_planes(np.concatenate(lengths))], [docs], [held], [learned]]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names)

        names = [x.split()[0] for x in BLOCKS.split(", ")]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_())]
        state = fresh()
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                ids, tokens, lengths, docs, held, learned, size = state
                found, place, n = coded(part.column(1))
                own = np.fromiter((ids[w] if w else 0 for w in found), np.int64, len(found))[place]
                seq = np.zeros(len(own) + len(n), np.int64)  # 0, the end mark, stands behind each document
                inside = np.ones(len(seq), bool)
                inside[np.cumsum(n + 1) - 1] = False
                seq[inside] = own
                tokens.append(seq)
                lengths.append(n + 1)
                for x, c in zip((docs, held, learned), (0, 2, 3), strict=True):
                    x.extend(part.column(c).to_pylist())
                state = (ids, tokens, lengths, docs, held, learned, size + 6 * len(seq) + 10 * len(n))
                if state[-1] >= block_bytes:
                    yield from flush(*state)
                    number += 1
                    state = fresh()
        if state[3]:
            yield from flush(*state)

    return docs.select("doc_id", "text", "held_out", "learned").mapInArrow(run, BLOCKS)


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def pairs(both: DataFrame, wide: np.ndarray, parts: int) -> DataFrame:
    """For each block and part: its pairs by word (words, pairs of each), with contexts, training counts and local numbers."""

    def run(batches):
        for batch in batches:
            for block, hashes, tokens, lengths, learned in zip(*batch.columns, strict=True):
                hashes = hashes.values.to_numpy().view(np.uint64)
                learned = np.repeat(learned.values.to_numpy(zero_copy_only=False), _whole(lengths.as_py()))
                grams, local = pairs_of(_whole(tokens.as_py()), len(hashes))
                n = np.bincount(local[learned], minlength=len(grams))
                del local
                word, ctx = grams // len(hashes), hashes[grams % len(hashes)]
                by_ctx = np.isin(hashes, wide)[word]
                part = (mix64(hashes[word] + np.where(by_ctx, mix64(ctx), 0)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                for k in range(parts):
                    own = order[cuts[k] : cuts[k + 1]]
                    if len(own):
                        w, runs = np.unique(word[own], return_counts=True)
                        data = {"words": hashes[w].tobytes(), "runs": _planes(runs), "ctxs": ctx[own].tobytes(), "ns": _planes(n[own]), "locals": _planes(np.diff(own, prepend=0))}
                        yield from _table(PAIRS, 1, part=[k], block=[block.as_py()], **{c: [v] for c, v in data.items()}).to_batches()

    return both.select("block", "hashes", "tokens", "lengths", "learned").mapInArrow(run, PAIRS)


def _hashes(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint64)


def by_home(ctxs: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of distinct contexts by home, then hash, and where each home begins in it."""
    home = (mix64(ctxs) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((ctxs, home))
    return order, np.searchsorted(home[order], np.arange(parts + 1))


def count(parts: int, wide: np.ndarray):
    """Of one part's pairs, packed. kind 0: those learned twice or more, by word (a: words, b: pairs of each, c: contexts,
    d: n, e: the words' pairs learned once); 1: words (key, n, singles, pairs of kind 0 in idx); 2: for each home its
    contexts (a), with n (b), pairs learned once (c) and in all (d); 3: for a block, the local numbers of pairs that are
    not what it takes them for (a), with their number in kind 0 from 1, or 0 for a pair learned once (b); 4: pairs learned
    once (n) and twice (singles); 5: for each home its contexts (a) of pairs of kind 0 and how many (b); 6: words of `wide`
    (a) with their root customers here (b)."""

    def run(asked: pa.Table) -> pa.Table:
        get = lambda c, f: [f(x.as_py()) for x in asked[c]]
        runs, ns, ctxs = get("runs", _whole), get("ns", _whole), get("ctxs", _hashes)
        key = np.concatenate([np.repeat(w, r) for w, r in zip(get("words", _hashes), runs, strict=True)])
        ctx, n = np.concatenate(ctxs), np.concatenate(ns)
        order = np.lexsort((ctx, key))
        k, c = key[order], ctx[order]
        first = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(first) - 1
        k, c, total = k[first], c[first], np.bincount(pair, n).astype(np.int64)
        del key, ctx, n, order, first
        many, once = total > 1, total == 1
        idx = np.cumsum(many) * many  # from 1
        part = asked["part"][0].as_py()
        words_, of_word = np.unique(k, return_inverse=True)
        ctxs_, of_ctx = np.unique(c, return_inverse=True)
        sums = lambda of, x, m: np.bincount(of, x, m).astype(np.int64)
        singles, some = sums(of_word, once, len(words_)), sums(of_word, many, len(words_))
        out = []

        def rows(kind, m, **cols):
            out.append(_table(COUNTS, m, kind=np.full(m, kind, np.int32), part=np.full(m, part, np.int32), **cols))

        n_word, n_ctx = sums(of_word, total, len(words_)), sums(of_ctx, total, len(ctxs_))
        known, sampled = n_word > 0, some > 0
        if many.any():
            rows(0, 1, a=[words_[sampled].tobytes()], b=[_planes(some[sampled])], c=[c[many].tobytes()], d=[_planes(total[many])], e=[_planes(singles[sampled])])
        rows(1, int(known.sum()), key=words_[known].view(np.int64), n=n_word[known], singles=singles[known], idx=some[known])
        for kind, there, values in ((2, n_ctx > 0, (n_ctx, sums(of_ctx, once, len(ctxs_)), sums(of_ctx, total > 0, len(ctxs_)))), (5, sums(of_ctx, many, len(ctxs_)) > 0, (sums(of_ctx, many, len(ctxs_)),))):
            own, values = ctxs_[there], [v[there] for v in values]
            order, cuts = by_home(own, parts)
            for home in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[home] : cuts[home + 1]]
                rows(kind, 1, home=[home], a=[own[at].tobytes()], **{x: [_planes(v[at])] for x, v in zip("bcd", values, strict=False)})
        rows(4, 1, n=[int(once.sum())], singles=[int((total == 2).sum())])
        here = np.isin(words_, wide) & known
        if here.any():
            rows(6, 1, a=[words_[here].tobytes()], b=[_planes((singles + some)[here])])
        at = 0
        for block, own, local in zip(asked["block"].to_pylist(), ns, get("locals", _whole), strict=True):
            of = pair[at : at + len(own)]
            at += len(own)
            other = np.flatnonzero(many[of] | (once[of] & (own == 0)))
            if len(other):
                rows(3, 1, block=[block], a=[_planes(np.diff(np.cumsum(local)[other], prepend=0))], b=[_planes(idx[of[other]])])
        return pa.concat_tables(out)

    return run


def gather(sent: pa.Table) -> pa.Table:
    """A home's contexts from what all parts have sent (kind 2 of count)."""
    get = lambda c, f: np.concatenate([f(x.as_py()) for x in sent[c]])
    keys, of = np.unique(get("a", _hashes), return_inverse=True)
    n, singles, types = (np.bincount(of, get(c, _whole), len(keys)).astype(np.int64) for c in "bcd")
    return _table(HOMES, 1, home=[sent["home"][0].as_py()], types=[int(types.sum())], keys=[keys.tobytes()], customers=[n.tobytes()], singles=[singles.tobytes()])


def settle(each: bool):
    """The tables of a home's contexts from what parts have seated (home, part, a: contexts, b: tables). kind 0: a part's
    contexts, in the same order, with all their tables (a); 1: the tables of the home (x); with `each`, 2: contexts (key)
    with customers (n) and tables (x)."""

    def run(homes, seats):
        row = homes.to_pylist()[0]
        keys, tables = _hashes(row["keys"]), np.frombuffer(row["singles"], np.int64).astype(float)
        at = [np.searchsorted(keys, _hashes(x.as_py())) for x in seats["a"]]
        for k, x in zip(at, seats["b"], strict=True):
            tables[k] += _whole(x.as_py())
        out = [_table(TOLD, len(at), kind=np.zeros(len(at), np.int32), part=seats["part"].combine_chunks(), home=seats["home"].combine_chunks(), a=[_planes(tables[k].astype(np.int64)) for k in at])] if at else []
        out.append(_table(TOLD, 1, kind=np.ones(1, np.int32), home=[row["home"]], x=[tables.sum()]))
        if each:
            out.append(_table(TOLD, len(keys), kind=np.full(len(keys), 2, np.int32), key=keys.view(np.int64), n=np.frombuffer(row["customers"], np.int64), x=tables))
        return pa.concat_tables(out)

    return run


def times(a, b: int) -> np.uint64:
    """Product modulo 2^64."""
    return np.uint64(int(a) * b & (2**64 - 1))


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    return (mix64(key + times(ODD, step + 1)) >> np.uint64(11)).astype(float) / 2.0**53


def reseat(n: np.ndarray, gain: np.ndarray, d: float, p: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Tables after n customers of each dish sit down. gain: strength and discounts of the restaurant's other tables;
    p: the parent's probability of the dish."""
    tables = np.minimum(n, 1).astype(float)
    live = np.flatnonzero(n > 1)
    j = 1
    while len(live):
        t, a = tables[live], (gain[live] + d * tables[live]) * p[live]
        new = a / (a + np.maximum(j - d * t, 1e-9))
        if j < EXACT:
            m = 1
            tables[live] = t + (_uniform(key[live], j) < new)
        else:
            block = np.minimum(n[live] - j, max(1, j // 4))
            m = max(1, j // 4)
            z = np.sqrt(-2 * np.log(np.maximum(_uniform(key[live], 2 * j), 1e-12))) * np.cos(2 * math.pi * _uniform(key[live], 2 * j + 1))
            tables[live] = t + np.clip(np.rint(block * new + z * np.sqrt(block * new * (1 - new))), 0, block)
        j += m
        live = live[n[live] > j]
    return tables


class Restaurants:
    """Totals of all restaurants, and what follows from them."""

    def __init__(self, n_words: int, n_tokens: int, d0: float, d1: float, customers: np.ndarray, tables: np.ndarray, root: float, theta: float = 1.0):
        self.v, self.n, self.d0, self.d1, self.theta = n_words, n_tokens, d0, d1, theta
        self.customers, self.tables, self.root = customers, tables, root

    def root_p(self, c: np.ndarray) -> np.ndarray:
        """Of known words with c root customers, each word having one root table."""
        return (np.maximum(c - self.d0, 0) + self.new_mass() * KNOWN_SHARE / max(1, self.v)) / (self.theta + self.root)

    def new_mass(self) -> float:
        return self.theta + self.d0 * self.v

    def unknown_p(self) -> float:
        return 1.0 if not self.v else self.new_mass() * (1 - KNOWN_SHARE) / (self.theta + self.root)

    def backing(self) -> np.ndarray:
        return (self.theta + self.d1 * self.tables) / (self.theta + self.customers)


def sweep_words(key: np.ndarray, row: np.ndarray, ctx: np.ndarray, n: np.ndarray, direct: np.ndarray, r: Restaurants, sweeps: int, burn_in: int, ctx_key: np.ndarray | None = None, mean_tables: np.ndarray | None = None):
    """key and direct: per word; row, ctx and n: per (word, context). Tables at the end, root customers at the end, and the
    averaged probabilities of words in the root and in their contexts. ctx_key: what random numbers come from instead of
    ctx; mean_tables: takes the averaged tables."""
    tables = np.ones(len(n))
    gram_key = mix64(key.view(np.uint64)[row] + (ctx if ctx_key is None else ctx_key).astype(np.uint64) * ODD)
    sums, root_sums = np.zeros(len(n)), np.zeros(len(key))
    for s in range(sweeps):
        c = direct + np.bincount(row, tables, len(key))
        p = r.root_p(np.maximum(c[row] - tables, 0.0) + 1.0)
        gain = r.theta + r.d1 * np.maximum(r.tables[ctx] - tables, 0)
        tables = reseat(n, gain, r.d1, p, gram_key + times(0xD1342543DE82EF95, s))
        if s >= burn_in:
            p0 = r.root_p(direct + np.bincount(row, tables, len(key)))
            root_sums += p0
            if mean_tables is not None:
                mean_tables += tables / (sweeps - burn_in)
            sums += (n - r.d1 * tables) / (r.theta + r.customers[ctx]) + r.backing()[ctx] * p0[row]
    c = direct + np.bincount(row, tables, len(key))
    return tables, c, root_sums / (sweeps - burn_in), sums / (sweeps - burn_in)


def draw(state: DataFrame, told: DataFrame, everywhere: dict, parts: int, r: Restaurants, sweeps: int, burn_in: int, last: bool) -> DataFrame:
    """Sweeps of every part. state: kind 0 of count; told: kind 0 of settle, and kind 6: the part's own root customers of
    words in several parts (a, b), of which everywhere has the sums. kind 0: for each home, contexts (a) with their tables
    of sampled pairs (b); 6: as in told, renewed. With `last` instead 2: words with their averaged root probability; 3: for
    each pair, n less the discounts (a)."""

    def run(state, told):
        if not state.num_rows:
            return _table(DRAWS, 0)
        row = state.to_pylist()[0]
        part, words_, runs, ctx, n = row["part"], _hashes(row["a"]), _whole(row["b"]), _hashes(row["c"]), _whole(row["d"]).astype(float)
        ctxs_, of = np.unique(ctx, return_inverse=True)
        order, cuts = by_home(ctxs_, parts)
        tables, own = np.zeros(len(ctxs_)), {}
        for x in told.to_pylist():
            if x["kind"] == 0:
                tables[order[cuts[x["home"]] : cuts[x["home"] + 1]]] = _whole(x["a"])
            else:
                own = dict(zip(_hashes(x["a"]).tolist(), _whole(x["b"]).tolist(), strict=True))
        away = np.zeros(len(words_))
        for k in np.flatnonzero(np.isin(words_, np.array(list(own), np.uint64))) if own else ():
            away[k] = everywhere[int(words_[k])] - own[int(words_[k])]
        local = Restaurants(r.v, r.n, r.d0, r.d1, np.zeros(len(ctxs_)), tables, r.root, r.theta)
        mean = np.zeros(len(n))
        spot = np.repeat(np.arange(len(words_)), runs)
        seated, c, p, _ = sweep_words(words_.view(np.int64), spot, of, n, _whole(row["e"]) + away, local, sweeps, burn_in, ctx.view(np.int64), mean)
        out = []

        def rows(kind, m, **cols):
            out.append(_table(DRAWS, m, kind=np.full(m, kind, np.int32), part=np.full(m, part, np.int32), **cols))

        if last:
            rows(2, len(words_), key=words_.view(np.int64), x=p)
            rows(3, 1, a=[(n - r.d1 * mean).astype(np.float32).tobytes()])
        else:
            x = np.bincount(of, seated).astype(np.int64)
            for home in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[home] : cuts[home + 1]]
                rows(0, 1, home=[home], a=[ctxs_[at].tobytes()], b=[_planes(x[at])])
            if own:
                now = own | dict(zip(words_.tolist(), (c - away).tolist(), strict=True))
                rows(6, 1, a=[np.array(list(own), np.uint64).tobytes()], b=[_planes(np.array([now[w] for w in own]).astype(np.int64))])
        return pa.concat_tables(out)

    return state.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(run, DRAWS)


def _answer(d1: float):
    """Of a part: its blocks' pairs that ask, with their numerators."""

    def run(links, values):
        num = np.concatenate([[np.float32(1 - d1)], *(np.frombuffer(x.as_py(), np.float32) for x in values["a"])])
        data = [num[_whole(x.as_py())].tobytes() for x in links["b"]]
        return _table(ANSWERS, links.num_rows, block=links["block"], locals=links["a"].combine_chunks(), nums=data)

    return run


def _discount(ones: float, twos: float) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones and twos else 0.5


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None, block_bytes: int = 10 << 20, outer: int = 2, sweeps: int = 6, burn_in: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held = mod_crc(F.col(id_col), 5) == 1 if held_out is None else held_out
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held, F.lit(False)).alias("held_out"), F.coalesce(~held, F.lit(False)).alias("learned"))
    parts = width(docs.sparkSession)
    spread = [END, *frequent(rows.where("learned"), "text", 1 / (8 * parts))]
    wide = np.array(sorted(map(_hash, spread)), np.uint64)
    both = materialise(blocks(rows, block_bytes), "zstd", 1)
    counted = materialise(pairs(both, wide, parts).repartitionById(parts, "part").groupBy("part").applyInArrow(count(parts, wide), COUNTS), "zstd", by="kind")

    vocabulary = materialise(counted.where("kind = 1").groupBy("key").agg(F.sum("n").alias("c"), F.sum("singles").alias("singles")))
    homes = materialise(counted.where("kind = 2").select("home", "a", "b", "c", "d").groupBy("home").applyInArrow(gather, HOMES), "zstd")
    state = counted.where("kind = 0").select("part", "a", "b", "c", "d", "e")
    ones = counted.where("kind = 4").agg(F.sum("n"), F.sum("singles")).first()
    whole = vocabulary.agg(F.count("*").alias("v"), F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2")).first()
    v, n = whole["v"], whole["n"] or 0
    n_types = homes.agg(F.sum("types")).first()[0] or 0
    r = Restaurants(v, n, _discount(whole["n1"] or 0, whole["n2"] or 0), _discount(ones[0] or 0, ones[1] or 0), np.zeros(1), np.zeros(1), float(n_types))

    def renew(seats: DataFrame, each: bool = False) -> DataFrame:
        own = seats.where("kind IN (0, 5)").select("home", "part", "a", "b")
        return homes.groupBy("home").cogroup(own.groupBy("home")).applyInArrow(settle(each), TOLD)

    def drawn(seats: DataFrame, told: DataFrame, last: bool) -> DataFrame:
        """told: as settle gives it for the seats."""
        own = seats.where("kind = 6").select("kind", "part", "home", "a", "b")
        everywhere: Counter = Counter()
        for x in own.collect():  # words of `spread` alone
            everywhere.update(dict(zip(_hashes(x["a"]).tolist(), _whole(x["b"]).tolist(), strict=True)))
        return draw(state, told.where("kind = 0").select("kind", "part", "home", "a", "b").union(own), everywhere, parts, r, sweeps, burn_in, last)

    seats = counted.where("kind IN (5, 6)").select("kind", "part", "home", "a", "b")
    for _ in range(outer if v else 0):
        told = materialise(renew(seats), "zstd")
        renewed = materialise(drawn(seats, told, False), "zstd")
        drop(told, seats)
        seats = renewed
        told = materialise(renew(seats), "zstd")
        r = Restaurants(v, n, r.d0, r.d1, r.customers, r.tables, told.where("kind = 1").agg(F.sum("x")).first()[0], r.theta)
        drop(told)

    told = materialise(renew(seats, True), "zstd")
    values = materialise(drawn(seats, told, True), "zstd", by="kind")
    links = counted.where("kind = 3").select("part", "block", "a", "b")
    found = materialise(links.groupBy("part").cogroup(values.where("kind = 3").select("part", "a").groupBy("part")).applyInArrow(_answer(r.d1), ANSWERS), "zstd")
    drop(counted, homes)
    # a word that was never sampled sits in the root once for each pair
    plain = (F.greatest(F.col("singles") - r.d0, F.lit(0.0)) + r.new_mass() * KNOWN_SHARE / max(1, v)) / (r.theta + r.root)
    drawn_p = values.where("kind = 2").groupBy("key").agg(F.avg("x").alias("p"))
    known = vocabulary.join(drawn_p.hint("merge"), "key", "left").select("key", "c", F.coalesce("p", plain).cast("float").alias("p"))
    places = told.where("kind = 2").select("key", F.col("n").alias("customers"), F.col("x").cast("float").alias("tables"))
    every = known.join(places.hint("merge"), "key", "full")
    asked = both.select("block", F.posexplode("hashes").alias("at", "key")).join(every.hint("merge"), "key", "left")
    answered = materialise(asked.select("block", "at", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("p", F.lit(r.unknown_p()).cast("float")).alias("p"), F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("tables", F.lit(0.0).cast("float")).alias("tables")), "zstd")
    drop(vocabulary, told, values)
    answers = answered.unionByName(found, allowMissingColumns=True)
    base_total = math.log10(n + 0.5 * (v + 1))
    d1, theta = r.d1, r.theta

    def score(texts, found):
        at = found["at"].to_numpy(zero_copy_only=False)
        own = np.flatnonzero(~np.isnan(at.astype(float)))
        order = own[np.argsort(at[own])]
        c, p, customers, tables = (found[x].to_numpy(zero_copy_only=False)[order].astype(float) for x in ("c", "p", "customers", "tables"))
        row = texts.to_pydict()
        tokens, lengths = _whole(row["tokens"][0]), _whole(row["lengths"][0])
        grams, local = pairs_of(tokens, len(c))
        num = np.zeros(len(grams), np.float32)
        learned = np.bincount(local[np.repeat(np.array(row["learned"][0]), lengths)], minlength=len(grams))
        num[learned > 0] = 1 - d1
        for a, b in zip(found["locals"], found["nums"], strict=True):
            if a.is_valid:
                num[np.cumsum(_whole(a.as_py()))] = np.frombuffer(b.as_py(), np.float32)
        word, ctx = np.divmod(grams, len(c))
        lp = np.log10((num + (theta + d1 * tables)[ctx] * p[word]) / (theta + customers)[ctx])
        del num, learned, word, ctx, grams
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        sums = lambda x: np.add.reduceat(x, starts)
        base = np.log10(c + 0.5) - base_total
        cols = {"n_tokens": lengths, "n_known": sums((c[tokens] > 0).astype(np.int64)), "base_score": sums(base[tokens]), "score": sums(lp[local])}
        return pa.table({"doc_id": pa.array(row["doc_ids"][0], pa.int64()), "held_out": row["held"][0], **cols})

    texts = both.select(F.col("block").alias("of_block"), "doc_ids", "held", "learned", "tokens", "lengths")
    wide_enough = max(parts, 2 * both.count())  # few tasks get several blocks
    scored = texts.repartition(wide_enough, "of_block").groupBy("of_block").cogroup(answers.repartition(wide_enough, "block").groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
