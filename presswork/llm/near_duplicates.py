"""Problem 4: pairs of records whose word sets are similar above a threshold, over collections too large for pairs.

Each record is a set of tokens (words, or runs of consecutive words). Its fingerprint is the set folded into bits: every
token flips one bit, so the Hamming distance of two fingerprints never exceeds the size of the sets' symmetric
difference, and similarity t bounds that size by (1 - t) / (1 + t) of the two sizes. Distances of all fingerprints to
fixed reference fingerprints are computed once; inside the join a pair is discarded as soon as one coordinate differs by
more than its bound, and the survivors are verified on their token sets. Neither step can lose a pair.

Pairs meet by keys. Short sets use the two-token prefix filter, which loses no pair: with tokens ordered from rare to
frequent, sets that share o tokens share two within their first n - o + 2. Long sets, where every pair of prefix tokens
would be too many keys, use unweighted minwise hashes in bands of six: whether two sets meet depends on their similarity
alone, not on how many records hold their tokens. Their fingerprint has one bit of each of 512 minwise hashes, whose
Hamming distance tells the similarity of sets of any size. Equal sets are one class from the start and are opened to their
records last.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.pivots import packed_exprs
from presswork.session import read_table, written

#: Buckets of the table of token counts: its size is fixed. Tokens that share a bucket share a place in the order, which
#: costs candidates but no result.
COUNT_BUCKETS = 1 << 18
#: Minwise hash functions for long sets; hashes of a band; bands in which a function takes part. There are
#: FUNCTIONS // BAND_HASHES * USES = 510 bands. A pair of similarity s is missed with probability (1 - s ** 6) ** 510 if
#: bands were independent: 3e-4 at 1/2, 6e-7 at 0.55, whatever the number of records that hold its tokens; as each
#: function serves three bands it is about twice that. Six hashes keep pairs of similarity 0.2, of which a corpus of one
#: subject has far more, to one in 31.
FUNCTIONS, BAND_HASHES, USES = 1024, 6, 3
#: Bits of the fingerprint of long sets, and the standard deviations by which a pair at the threshold may miss its expected
#: distance: one such pair in 300,000 exceeds it.
SIGNATURE_BITS, DEVIATIONS = 512, 4.5
#: Bands by which groups of many near copies are noticed, records of a key that make such a group, records of a block.
PROBE_BANDS, GROUP_LEAST, BLOCK = 8, 300, 200
#: Tokens that a pair of blocks compares at a time.
COLUMNS = 4096
#: Sets from this size on use single prefix tokens as keys instead of pairs of them.
PAIR_KEYS_BELOW = 40
FOLD_BITS = 128
WORDS_KEPT = 500_000
#: Records whose tokens are in memory at a time.
SLICE = 2000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (two rounds of multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Tokens:
    """Token hashes of texts: distinct words (run = 1) or distinct runs of consecutive words, in lower case.

    A word is a maximal run of letters or digits. Texts with fewer words than least_words have no tokens.
    """

    def __init__(self, run: int, least_words: int = 1):
        import regex
        import xxhash

        self.find = regex.compile(r"[\p{L}\p{Nd}]+").findall
        self.hash = xxhash.xxh64_intdigest
        self.run, self.least = run, max(least_words, run)
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray | None:
        """Sorted distinct 64-bit hashes; None where the text has no tokens."""
        _, tokens, bounds = self.sets([text])
        return tokens if len(bounds) > 1 else None

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the texts that have tokens, their sorted distinct hashes one set after the other, bounds of the sets)."""
        known, hash_of = self.known, self.hash
        if len(known) > WORDS_KEPT:
            known.clear()
        at, sizes, flat = [], [], []
        for i, text in enumerate(texts):
            words = self.find(text.lower()) if text else []
            if len(words) < self.least:
                continue
            at.append(i)
            sizes.append(len(words))
            for w in words:
                h = known.get(w)
                if h is None:
                    h = known[w] = hash_of(w)
                flat.append(h)
        h = np.array(flat, dtype=np.uint64)
        owner = np.repeat(np.arange(len(at)), sizes)
        if self.run > 1 and len(at):
            n = len(h) - self.run + 1
            acc = np.zeros(n, dtype=np.uint64)
            for i in range(self.run):
                acc = _mix(acc * _M1 + h[i : i + n])
            inside = owner[:n] == owner[self.run - 1 :]
            h, owner = acc[inside], owner[:n][inside]
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        if len(h):
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
            h, owner = h[first], owner[first]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(at)))])
        return np.array(at, dtype=np.int64), h, bounds


def _buckets(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - COUNT_BUCKETS.bit_length() + 1)).astype(np.int64)


def token_counts(records: DataFrame, text: str, run: int, least_words: int) -> np.ndarray:
    """How many records have a token of each bucket, over all records. COUNT_BUCKETS numbers, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = Tokens(run, least_words), np.zeros(COUNT_BUCKETS, dtype=np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo in range(0, len(texts), SLICE):
                total += np.bincount(_buckets(tokens.sets(texts[lo : lo + SLICE])[1]), minlength=COUNT_BUCKETS)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    sums = records.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = sums.toArrow()
    out = np.zeros(COUNT_BUCKETS, dtype=np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def prefix_keys(tokens: np.ndarray, bounds: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(owners, keys): keys by which every other set of similarity >= threshold meets each set, for sets that differ.

    Sets of fewer than three tokens have none: for thresholds above 2/3 they are similar only if equal.
    """
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((tokens, counts[_buckets(tokens)], owner))
    ranked = tokens[order]
    base = n - np.ceil(threshold * n - 1e-9).astype(np.int64)
    owners, keys = [], []
    pairs = np.nonzero((n >= 3) & (n < PAIR_KEYS_BELOW))[0]
    if len(pairs):
        size = np.minimum(base[pairs] + 2, n[pairs])
        place = np.arange(size.max())
        inside = place[None, :] < size[:, None]
        head = np.full(inside.shape, np.iinfo(np.uint64).max, dtype=np.uint64)
        head[inside] = ranked[(bounds[:-1][pairs][:, None] + place)[inside]]
        head.sort(axis=1)
        for i, j in itertools.combinations(place.tolist(), 2):
            has = size > j
            owners.append(pairs[has])
            keys.append(_mix(head[has, i] * _M1 + head[has, j]))
    single = np.nonzero((n >= 3) & (n >= PAIR_KEYS_BELOW * threshold))[0]
    for s in single.tolist():
        owners.append(np.full(base[s] + 1, s))
        keys.append(_mix(ranked[bounds[s] : bounds[s] + base[s] + 1] + _M1))
    if not keys:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    owners, keys = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(owners, kind="stable")
    return owners[order], keys[order].view(np.int64)


class BandKeys:
    """Keys of long sets: groups of BAND_HASHES of FUNCTIONS minwise hashes."""

    def __init__(self):
        numbers = np.arange(1, FUNCTIONS + 1, dtype=np.uint64)
        self.factors = (_mix(numbers * _M1) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        # each use of the functions puts all of them in another order and cuts it into bands
        whole = FUNCTIONS // BAND_HASHES
        orders = [np.argsort(_mix((numbers + np.uint64(u * FUNCTIONS)) * _M1))[: whole * BAND_HASHES] for u in range(1, USES + 1)]
        self.bands = np.concatenate(orders).reshape(whole * USES, BAND_HASHES)

    def least(self, tokens: np.ndarray) -> np.ndarray:
        """The least value of each function, a * token + b of the two halves of a token, over the set."""
        m = _mix(tokens)
        a, b = (m >> np.uint64(32)).astype(np.uint32), m.astype(np.uint32)
        step = max(1, 16_384 // len(tokens))  # few functions at a time, so that their values stay in the cache
        out = []
        for lo in range(0, len(self.factors), step):
            x = self.factors[lo : lo + step, None] * a
            x += b
            out.append(x.min(axis=1))
        return np.concatenate(out)

    def __call__(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a 32-bit key for each band, to be told apart by the band's number; the fingerprint)."""
        least = self.least(tokens)
        key = np.zeros(len(self.bands), dtype=np.uint64)
        for h in least.astype(np.uint64)[self.bands].T:
            key = _mix(key * _M1 + h)
        bits = (least[:SIGNATURE_BITS] * np.uint32(0x9E3779B1)) >> np.uint32(31)
        return (key >> np.uint64(32)).astype(np.uint32).view(np.int32), np.packbits(bits.astype(np.uint8)).view(np.int64)


def _folded(tokens: np.ndarray, bounds: np.ndarray, bits: int) -> np.ndarray:
    """The sets folded into bits: each token flips one. A row of longs for each set."""
    sets = len(bounds) - 1
    at = (_mix(tokens) >> np.uint64(20)) % np.uint64(bits)
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    flips = np.bincount(owner * bits + at.astype(np.int64), minlength=sets * bits).reshape(sets, bits)
    return np.packbits((flips & 1).astype(np.uint8), axis=1).view(np.int64)


def features(records: DataFrame, id_col: str, text: str, threshold: float, run: int, least_words: int, long_sets: bool) -> DataFrame:
    """(id, n, s1, s2, fold, keys) of every record with tokens: set size, set identity, fingerprint and join keys."""
    shared = None if long_sets else records.sparkSession.sparkContext.broadcast(token_counts(records, text, run, least_words))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(run, least_words)
        band = BandKeys() if long_sets else None
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo in range(0, len(texts), SLICE):
                at, t, bounds = tokens.sets(texts[lo : lo + SLICE])
                if not len(at):
                    continue
                m, starts = _mix(t + _M1), bounds[:-1]
                if band:
                    made = [band(t[x:y]) for x, y in zip(starts, bounds[1:])]
                    keys, fold = (np.stack([x[i] for x in made]) for i in (0, 1))
                    keys = _lists(keys.ravel(), np.full(len(at), keys.shape[1]))
                else:
                    fold = _folded(t, bounds, FOLD_BITS)
                    owners, values = prefix_keys(t, bounds, shared.value, threshold)
                    keys = _lists(values, np.bincount(owners, minlength=len(at)))
                columns = [
                    b.column(0).take(pa.array(at + lo)), pa.array(np.diff(bounds).astype(np.int32)),
                    pa.array(np.bitwise_xor.reduceat(m, starts).view(np.int64)), pa.array(np.add.reduceat(m * _M2, starts).view(np.int64)),
                    _lists(fold.ravel(), np.full(len(at), fold.shape[1])), keys,
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "s1", "s2", "fold", "keys"])

    kind = "int" if long_sets else "long"
    return records.select(F.col(id_col).cast("long").alias("id"), text).mapInArrow(compute, f"id long, n int, s1 long, s2 long, fold array<long>, keys array<{kind}>")


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _bound(threshold: float) -> str:
    """SQL text of the largest symmetric difference that sets of sizes l.n and r.n may have."""
    return f"floor({(1 - threshold) / (1 + threshold)!r} * (l.n + r.n) + 1e-9)"


def _coordinates_within(threshold: float) -> str:
    """SQL text of the test on the eight carried coordinates."""
    return " AND ".join(f"abs((shiftright(l.v1, {8 * k}) & 255) - (shiftright(r.v1, {8 * k}) & 255)) <= {_bound(threshold)}" for k in range(8))


def near_copy_groups(classes: DataFrame) -> DataFrame:
    """(id, n, grp): classes of long sets in a group of many near copies, named by its first class.

    Near copies meet in nearly every band, so a group of n would be compared n^2 / 2 times in each. A key of the first
    PROBE_BANDS that GROUP_LEAST classes hold makes a group of them; a class with several belongs to the one that begins
    first. Pairs inside a group are compared once, in blocks (group_links); all other pairs still meet by their keys.
    """
    rows = classes.select("id", "n", F.posexplode(F.slice("keys", 1, PROBE_BANDS)).alias("band", "key"))
    hot = rows.groupBy("band", "key").agg(F.min("id").alias("grp"), F.count(F.lit(1)).alias("m")).where(F.col("m") >= GROUP_LEAST).drop("m")
    return rows.join(hot, ["band", "key"]).groupBy("id", "n").agg(F.min("grp").alias("grp"))


def group_links(groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of all similar pairs within each group, compared on their token sets.

    A group is cut into blocks of about BLOCK classes; each pair of blocks is a task's work of the same size, however large
    the group, and carries its sets once instead of once per pair. A class is sent to as many block pairs as its group has
    blocks.
    """
    blocks = groups.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = groups.join(blocks, "grp").withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(sets, "id")
    left = own.select("grp", F.col("at").alias("i"), F.explode(F.sequence("at", F.col("blocks") - 1)).alias("j"), "id", "tokens", F.lit(True).alias("is_left"))
    right = own.select("grp", F.explode(F.sequence(F.lit(0), F.col("at"))).alias("i"), F.col("at").alias("j"), "id", "tokens", F.lit(False).alias("is_left"))

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, is_left, tokens = t.column("id").to_numpy(), t.column("is_left").to_numpy(), t.column("tokens").chunk(0)
        sizes = np.diff(tokens.offsets.to_numpy())
        _, token, often = np.unique(tokens.flatten().to_numpy(), return_inverse=True, return_counts=True)
        owner, shared = np.repeat(np.arange(len(ids)), sizes), often[token] >= 2
        owner, token = owner[shared], np.unique(token[shared], return_inverse=True)[1]
        l, r = np.nonzero(is_left)[0], np.nonzero(~is_left)[0]
        common = np.zeros((len(l), len(r)), dtype=np.float32)
        for lo in range(0, int(token.max(initial=-1)) + 1, COLUMNS):  # a slice of the tokens at a time
            part = (token >= lo) & (token < lo + COLUMNS)
            has = np.zeros((len(ids), COLUMNS), dtype=np.float32)
            has[owner[part], token[part] - lo] = 1
            common += has[l] @ has[r].T
        similarity = common.astype(np.float64) / (sizes[l][:, None] + sizes[r][None, :] - common)
        hit = similarity >= threshold - 1e-9
        if t.column("i")[0] == t.column("j")[0]:
            hit &= ids[l][:, None] < ids[r][None, :]  # a block with itself
        x, y = np.nonzero(hit)
        a, b = ids[l][x], ids[r][y]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": similarity[x, y]})

    return left.unionByName(right).groupBy("grp", "i", "j").applyInArrow(compare, "a long, b long, similarity double")


def candidates(classes: DataFrame, threshold: float, long_sets: bool, groups: DataFrame | None = None) -> DataFrame:
    """(a, b, na, nb), a < b: classes that share a key and survive the coordinates' test, without pairs inside a group.

    Sizes are the coordinate of the empty reference set. Short sets carry eight distances to fixed reference fingerprints
    and the fingerprint through the join: coordinates discard most pairs there, the true distance nearly all others. For
    long sets at thresholds near 1/2 the bound exceeds any difference of such distances, so their longer fingerprints are
    compared once per distinct pair. A key that many classes hold is split by
    adaptive execution on both sides.
    """
    if long_sets:
        grouped = classes.withColumn("grp", F.lit(None).cast("long")) if groups is None else classes.join(groups.select("id", "grp"), "id", "left")
        rows = grouped.select("id", "n", "grp", F.posexplode("keys").alias("band", "key"))
        rows = rows.select("id", "n", *([] if groups is None else ["grp"]), F.expr("shiftleft(cast(band AS bigint), 32) | (key & 4294967295L)").alias("key"))
        tests = [] if groups is None else ["coalesce(l.grp <> r.grp, true)"]
    else:
        rows = classes.select("id", "n", F.col("fold")[0].alias("f0"), F.col("fold")[1].alias("f1"), "keys")
        rows = rows.withColumn("v1", F.expr(packed_exprs("f0", "f1")[0]))
        rows = rows.select("id", "n", "f0", "f1", "v1", F.explode("keys").alias("key"))
        tests = [_coordinates_within(threshold), f"bit_count(l.f0 ^ r.f0) + bit_count(l.f1 ^ r.f1) <= {_bound(threshold)}"]
    cond = " AND ".join(["l.key = r.key", "l.id < r.id", f"least(l.n, r.n) >= {threshold!r} * greatest(l.n, r.n) - 1e-9", *tests])
    pairs = rows.alias("l").join(rows.alias("r"), F.expr(cond)).selectExpr("l.id AS a", "r.id AS b", "l.n AS na", "r.n AS nb").distinct()
    if not long_sets:
        return pairs
    fold = classes.select("id", "fold")
    both = pairs.join(fold.selectExpr("id AS a", "fold AS fa"), "a").join(fold.selectExpr("id AS b", "fold AS fb"), "b")
    distance = " + ".join(f"bit_count(fa[{i}] ^ fb[{i}])" for i in range(SIGNATURE_BITS // 64))
    agree = (1 + threshold) / 2
    limit = SIGNATURE_BITS * (1 - agree) + DEVIATIONS * (SIGNATURE_BITS * agree * (1 - agree)) ** 0.5
    return both.where(F.expr(f"{distance} <= {int(limit)}")).select("a", "b", "na", "nb")


def token_sets(needed: DataFrame, records: DataFrame, id_col: str, text: str, run: int, least_words: int) -> DataFrame:
    """(id, tokens) of the needed ids; only their records are tokenised."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(run, least_words)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo in range(0, len(texts), SLICE):
                at, t, bounds = tokens.sets(texts[lo : lo + SLICE])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at + lo)), _lists(t.view(np.int64), np.diff(bounds))], names=["id", "tokens"])

    raw = records.select(F.col(id_col).cast("long").alias("id"), text).join(needed, "id", "left_semi")
    return raw.mapInArrow(tokenise, "id long, tokens array<long>")


def verified(pairs: DataFrame, records: DataFrame, id_col: str, text: str, threshold: float, run: int, least_words: int) -> DataFrame:
    """(a, b, similarity) of the candidate pairs whose token sets are similar."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = token_sets(needed, records, id_col, text, run, least_words)
    both = pairs.join(sets.selectExpr("id AS a", "tokens AS ta"), "a").join(sets.selectExpr("id AS b", "tokens AS tb"), "b")
    both = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("common"))
    similarity = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    return both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)


class NearDuplicates:
    """Classes of equal token sets of a table, and the similar pairs of classes.

    NULL and empty texts, and texts with fewer words than asked for, are in no class. Repeated ids must not occur. An
    empty table has no classes. Extra columns are not read.
    """

    def __init__(self, records: DataFrame, id_col: str, text: str, threshold: float, run: int = 1, least_words: int = 1, long_sets: bool = False):
        if not long_sets and threshold <= 2 / 3:
            raise ValueError("pairs of prefix tokens lose no pair only above a threshold of 2/3; use long_sets below")
        self.records, self.id_col, self.text, self.threshold = records, id_col, text, threshold
        self.run, self.least_words = run, least_words
        feats = written(features(records, id_col, text, threshold, run, least_words, long_sets), "features")
        firsts = feats.groupBy("s1", "s2").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("copies"))
        self.members = written(feats.select("id", "s1", "s2").join(firsts, ["s1", "s2"]).select("id", "cls", "copies"), "members")
        # copies are the exception; written, their size is known, and below Spark's threshold no fingerprint is shuffled
        copies = written(self.members.where("id <> cls").select("id"), "copies")
        reps = feats.join(copies, "id", "left_anti")
        groups = None
        if long_sets:
            groups = written(near_copy_groups(reps), "groups")
            groups = None if groups.isEmpty() else groups
        found = written(candidates(reps, threshold, long_sets, groups), "candidates")
        self.links = written(verified(found, records, id_col, text, threshold, run, least_words), "links")
        if groups is not None:
            sets = token_sets(groups.select("id"), records, id_col, text, run, least_words)
            self.links = self.links.unionByName(written(group_links(groups, sets, threshold), "group-links"))

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: all pairs of records, those of equal sets included.

        The result itself has a row per pair of copies; classes with one record and no link never enter these joins.
        """
        many = self.members.where("copies > 1")
        equal = many.alias("x").join(many.alias("y"), F.expr("x.cls = y.cls AND x.id < y.id")).selectExpr("x.id AS id_a", "y.id AS id_b")
        left = self.links.join(self.members.selectExpr("cls AS a", "id AS x"), "a")
        both = left.join(self.members.selectExpr("cls AS b", "id AS y"), "b")
        return equal.unionByName(both.selectExpr("least(x, y) AS id_a", "greatest(x, y) AS id_b"))

    def classes(self) -> DataFrame:
        """(id, cls, copies, links): class of each record and the number of other classes its class is similar to."""
        ends = self.links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
        return self.members.join(ends, "cls", "left").select("id", "cls", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


TITLES = {"id_col": "item_id", "text": "rss_title", "threshold": 0.75}
ARTICLES = {"id_col": "article_id", "text": "full_text", "threshold": 0.5, "run": 3, "least_words": 60, "long_sets": True}


def _tables(spark: SparkSession, sf_dir: str) -> list[tuple[str, NearDuplicates]]:
    return [
        ("rss_title", NearDuplicates(read_table(spark, sf_dir, "rss_items"), **TITLES)),
        ("full_text", NearDuplicates(read_table(spark, sf_dir, "fulltext"), **ARTICLES)),
    ]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [d.pairs().select(F.lit(name).alias("field_name"), "id_a", "id_b") for name, d in _tables(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [d.classes().select(F.lit(name).alias("field_name"), "id", "cls", "copies", "links") for name, d in _tables(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


QUERIES = {"p4_found": p4_found, "p4_classes": p4_classes}
ORACLE: dict[str, str] = {}
