"""N-gram Jaccard join by adaptive multi-match prefixes."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import LOWER, mix, prefix_sums, range_hash, slices, tidy, words
from .components import components
from .store import broadcast_if_small, in_boxes, save, shuffle_partitions, text_batches

SIZE, PERCENT = 5, 80
#: A token is frequent if it is in this part of the documents.
FREQUENT = 4096
#: Frequent tokens that go to the driver and to every task at most, 9 bytes each.
FREQUENT_TOKENS = 1 << 20
#: Candidates that a token outside the frequent ones is taken to bring, and postings that a token of a set in a check costs.
RARE, CHECK = 0.25, 1 / 16
#: Smallest tokens of a set that the first round looks at, and how many of them a pair must share there.
LOWEST, LOWEST_SHARED = 8, 3
#: A token's list is long if it has this many sets; pairs of long lists are held against each other by sketch first.
LONG = 8
#: 64-bit words of a sketch at most.
SKETCH_WORDS = 64
#: Postings that one group of the candidate search is meant to hold.
GROUP_POSTINGS = 1_000_000
#: Postings that a task gathers before it deals them to the groups.
EMIT_POSTINGS = 1 << 18
_MANY = 4096
#: Sets whose repetitions a task leaves out of its counts of frequent tokens; then it starts anew.
_SEEN = 100_000
_TOKEN = (1 << 48) - 1


def _hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of the texts' shingles and each one's text. Fewer words than size are one shingle."""
    data = LOWER[data]
    starts, ends, before = words(data, offsets)
    w = range_hash(prefix_sums(data), starts, ends)
    count = np.diff(before)
    text = np.repeat(np.arange(len(count)), count)
    length = np.minimum(count, size)
    first = np.flatnonzero(np.arange(len(w)) + length[text] <= before[1:][text])
    length = length[text[first]]
    h = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(size):
        more = length > j
        if more.all():
            h = h * np.uint64(0xC2B2AE3D27D4EB4F) + w[first + j]
        elif more.any():
            h[more] = h[more] * np.uint64(0xC2B2AE3D27D4EB4F) + w[first[more] + j]
    return mix(h) & np.uint64(_TOKEN), text[first]


def shingle_sets(column: pa.Array, size: int = SIZE, frequent: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, keys, offsets): each text's distinct shingles in one global order, frequent ones last.

    A key is the token's class (0: not frequent, else about log2 of the number
    of documents) above its 48-bit hash. frequent: sorted tokens and classes.
    """
    for begin, stop, data, offsets in slices(column):
        for at in range(0, stop - begin, _MANY):
            end = min(at + _MANY, stop - begin)
            own = offsets[at : end + 1]
            tokens, text = _hashes(data[own[0] : own[-1]], own - own[0], size)
            if frequent is not None and len(frequent[0]):
                i = np.minimum(np.searchsorted(frequent[0], tokens), len(frequent[0]) - 1)
                tokens |= np.where(frequent[0][i] == tokens, frequent[1][i], 0).astype(np.uint64) << np.uint64(48)
            keys = np.sort(tokens | text.astype(np.uint64) << np.uint64(52))
            if len(keys):
                keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
            bounds = np.searchsorted(keys, np.arange(end - at + 1, dtype=np.uint64) << np.uint64(52)) if end - at < _MANY else np.append(np.searchsorted(keys, np.arange(end - at, dtype=np.uint64) << np.uint64(52)), len(keys))
            yield begin + at, begin + end, keys & np.uint64((1 << 52) - 1), bounds


def _ids(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, whatever the order of its tokens."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix((keys & np.uint64(_TOKEN)) + np.uint64(1)), dtype=np.uint64)])
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def sketches(keys: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set: 64-bit words that say of each bucket of its tokens whether it holds an odd number, and where each set's words begin.

    A token that only one of two sets has changes one bit, so their sketches
    differ in no more bits than the sets have tokens alone. A set has 2 to 4 bits
    a token, as a power of two, and SKETCH_WORDS words at most.
    """
    n = np.diff(offsets)
    size = np.minimum(1 << np.ceil(np.log2(np.maximum(n / 32, 1))).astype(np.int64), SKETCH_WORDS)
    starts = np.concatenate([[0], np.cumsum(size)])
    at = 64 * np.repeat(starts[:-1], n) + (keys.astype(np.int64) & np.repeat(64 * size - 1, n))
    odd = (np.bincount(at, minlength=64 * starts[-1]) & 1).astype(bool)
    return np.packbits(odd, bitorder="little").view("<i8"), starts


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def named_texts(docs: DataFrame) -> DataFrame:
    """(_id, _key, text): a row is named by its doc_id and a hash of its text, as rows may share a doc_id or have none."""
    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_key"), "text")


def _named(table: DataFrame, names: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of table (_id, _key, ...) whose name is in names (_doc, _hash, ...)."""
    return table.join(names, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_hash")), how).drop("_doc", "_hash")


def _once(table: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """table (_id, _key, ...) with one row of each name that the saved table names (_doc, _hash) has."""
    if names.isEmpty():
        return table
    return _named(table, names, "left_anti").unionByName(save(_named(table, names, "left_semi").dropDuplicates(["_id", "_key"]), name))


def profiles(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row (doc_id, key, set_id, n, lowest, sketch, common) for each of named_texts, and rows (token, docs) for tokens that a run of texts has often.

    common: how many of the tokens other texts of the run have; it only serves to choose whom others are held against first.
    """
    names = ["doc_id", "key", "set_id", "n", "lowest", "sketch", "common", "token", "docs"]

    @tidy
    def profile(batches):
        seen: set[int] = set()
        for batch in batches:
            for first, end, keys, offsets in shingle_sets(batch.column(1), size):
                n, ids = np.diff(offsets), _ids(keys, offsets)
                few = np.minimum(n, LOWEST)
                stops = np.concatenate([[0], np.cumsum(few)])
                at = np.arange(stops[-1]) - np.repeat(stops[:-1], few) + np.repeat(offsets[:-1], few)
                lowest = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(keys[at].view(np.int64)))
                words, starts = sketches(keys, offsets)
                sketch = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(words))
                if len(seen) > _SEEN:
                    seen.clear()
                fresh = np.array([x not in seen and not seen.add(x) for x in ids.tolist()], bool)
                tokens, which, counts = np.unique(keys[np.repeat(fresh, n)], return_inverse=True, return_counts=True)
                met = np.concatenate([[0], np.cumsum(counts[which] > 1)])
                stops = np.concatenate([[0], np.cumsum(n[fresh])])
                common = np.zeros(end - first, np.int64)
                common[fresh] = met[stops[1:]] - met[stops[:-1]]
                none = pa.nulls(end - first, pa.int64())
                yield _rows(names, batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first), ids, n, lowest, sketch, common, none, none)
                often = counts >= max(3, fresh.sum() // 256)
                none = pa.nulls(int(often.sum()), pa.int64())
                yield _rows(names, none, none, none, none, *[pa.nulls(len(none), pa.list_(pa.int64()))] * 2, none, tokens[often].view(np.int64), counts[often])

    return save(docs.select(F.col("_id").alias("doc_id"), "text", "_key").mapInArrow(profile, "doc_id long, key long, set_id long, n long, lowest array<long>, sketch array<long>, common long, token long, docs long"), "profiles")


def _frequent(profile: DataFrame, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens and their classes. Of more than FREQUENT_TOKENS the most frequent are taken, in steps of the fourth root of 2; the order of tokens never changes which pairs link."""
    found = profile.where("token is not null").groupBy("token").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= max(8, documents // FREQUENT))
    found = save(found.withColumn("step", F.floor(4 * F.log2("docs"))), "frequent")
    least, room = 0, FREQUENT_TOKENS
    for step, n in sorted(map(tuple, found.groupBy("step").count().collect()), reverse=True):
        room -= n
        if room < 0:
            least = step + 1
            break
    found = found.where(F.col("step") >= least).toPandas()
    tokens = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    classes = np.clip(np.log2(np.maximum(found["docs"].to_numpy(np.int64), 2)).astype(np.int64) - 1, 1, 15).astype(np.uint8)
    return tokens[order], classes[order]


def prefix_lengths(keys: np.ndarray, offsets: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Of each set: the length of its prefix, and how many of its tokens a linked set shares at least.

    With t the least overlap that any link needs, linked sets share l tokens of
    their first n - t + l, for each l. A larger l costs more postings and leaves
    fewer candidates to check; the l with the least estimated cost is taken,
    where a frequent token brings as many candidates as its class says.
    """
    n = np.diff(offsets)
    base = n - (percent * n + 99) // 100 + 1
    others = np.where(keys >> np.uint64(48), np.uint64(2) << (keys >> np.uint64(48)), np.uint64(0)).astype(np.float64)
    others[others == 0] = RARE
    sums = np.concatenate([[0.0], np.cumsum(others)])
    best, least = np.ones(len(n), np.int64), np.full(len(n), np.inf)
    for l in [np.full(len(n), k) for k in (1, 2, 3, 4, 6, 8)] + [n // k for k in (64, 40, 24, 16)]:
        length = base + l - 1
        met = sums[offsets[:-1] + np.minimum(length, n)] - sums[offsets[:-1]]
        cost = np.where((length <= n) & (l > 0), length + met + met / np.maximum(l, 1) * n * CHECK, np.inf)
        best, least = np.where(cost < least, l, best), np.minimum(cost, least)
    best = np.minimum(best, 65535)
    return np.where(n > 0, np.minimum(base + best - 1, n), 0), best


#: Of a posting's set: n tokens, k of them not frequent, l; i: the token's place. Numbers end at CAP; sets that large pass the filters that use them.
CAP = 65535
_NUMBERS = ["n", "k", "l", "i"]
_RARE = np.dtype([("token", "<u4"), *[(x, "<u2") for x in _NUMBERS], ("set_id", "<i8")])
_LABELLED = np.dtype([*_RARE.descr, ("c", "<i8")])
_OFTEN = np.dtype([("token", "<i8"), *_LABELLED.descr[1:]])
_ROW = ["token", "set_id", *_NUMBERS, "c"]
#: Set in the number of a frequent token.
_OFTEN_BIT = 1 << 62


def _runs_of(token: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which rows, sorted by token, have a token with more than one c."""
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    mixed = np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)
    return np.repeat(mixed, np.diff(np.append(first, len(token))))


def postings(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], total: int, size: int, percent: int) -> DataFrame:
    """(token, set_id, n, k, l, i, c) of the prefix tokens that sets of different components share, from (text, set_id, c).

    Tokens that aren't frequent are dealt by hash into parts, packed as binary,
    and sorted part by part; a token within one component ends there. Frequent
    tokens are dealt by set, so that no part holds all of one, and go on as rows.
    """
    spark = texts.sparkSession
    parts = max(2 * shuffle_partitions(spark), total * (100 - percent) // 100 // GROUP_POSTINGS + 1)
    shared = spark.sparkContext.broadcast(frequent)

    @tidy
    def emit(batches):
        kinds = (_RARE, _LABELLED, _OFTEN)
        for batch in batches:
            given, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            chunks, held = ([], [], []), 0
            for first, end, keys, offsets in shingle_sets(batch.column(0), size, shared.value):
                n, ids, c = np.diff(offsets), _ids(keys, offsets), labels[first:end]
                length, l = prefix_lengths(keys, offsets, percent)
                length = np.where(ids == given[first:end], length, 0)
                frequent_before = np.concatenate([[0], np.cumsum(keys >> np.uint64(48) > 0)])
                k = n - (frequent_before[offsets[1:]] - frequent_before[offsets[:-1]])
                l = np.where(length > k, 1, l)  # not all of its matches are counted
                doc = np.repeat(np.arange(len(n)), length)
                place = np.arange(len(doc)) - np.repeat(np.cumsum(length) - length, length)
                token = keys[place + offsets[:-1][doc]]
                often, labelled = token >> np.uint64(48) > 0, (c != ids)[doc]
                for kind, rows, to in zip(kinds, (~often & ~labelled, ~often & labelled, often), chunks):
                    d, t = doc[rows], token[rows]
                    out = np.empty(len(d), kind)
                    out["set_id"] = ids[d]
                    for name, values in zip(_NUMBERS, (n[d], k[d], l[d], place[rows])):
                        out[name] = np.minimum(values, CAP)
                    if kind is _OFTEN:
                        out["token"], part = t.astype(np.int64) | _OFTEN_BIT, (out["set_id"] % parts).astype(np.int64)
                    else:
                        out["token"], part = t & np.uint64(0xFFFFFFFF), ((t >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                    if kind is not _RARE:
                        out["c"] = c[d]
                    to.append((part, out))
                held += len(doc)
                if held >= EMIT_POSTINGS:
                    yield from dealt(chunks)
                    chunks, held = ([], [], []), 0
            yield from dealt(chunks)

    def dealt(chunks):
        for i, chunk in enumerate(chunks):
            part, out = (np.concatenate([x[j] for x in chunk]) if chunk else np.zeros(0, np.int64) for j in (0, 1))
            order = np.argsort(part, kind="stable")
            part, out = part[order], out[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            if len(cuts):
                raw = pa.array([x.tobytes() for x in np.split(out, cuts[1:])], pa.binary())
                none = pa.nulls(len(cuts), pa.binary())
                yield _rows(["part", "rare", "labelled", "often"], part[cuts].astype(np.int32), *[raw if i == k else none for k in range(3)])

    def meet(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py() if len(table) else 0
        rare, labelled, often = (np.concatenate([np.zeros(0, kind)] + [np.frombuffer(x.as_buffer(), kind) for x in table.column(name).drop_null()]) for name, kind in (("rare", _RARE), ("labelled", _LABELLED), ("often", _OFTEN)))
        token = np.concatenate([rare["token"], labelled["token"]])
        if len(token):
            ordered = np.sort(token)
            twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            keep = np.isin(token, twice, kind="sort") if len(twice) else np.zeros(len(token), bool)
            n_rare = len(rare)
            rare, labelled, token = rare[keep[:n_rare]], labelled[keep[n_rare:]], token[keep]
        c = np.concatenate([rare["set_id"], labelled["c"]])
        order = np.argsort(token, kind="stable")
        if len(order):
            order = order[_runs_of(token[order], c[order])]
        columns = {"token": token.astype(np.int64) | part << 32, "c": c} | {k: np.concatenate([rare[k], labelled[k]]).astype(np.int64) for k in ("set_id", *_NUMBERS)}
        return pa.table({k: np.concatenate([columns[k][order], often[k].astype(np.int64)]) for k in _ROW})

    emitted = texts.select("text", "set_id", "c").mapInArrow(emit, "part int, rare binary, labelled binary, often binary")
    return save(emitted.groupBy("part").applyInArrow(meet, "token long, set_id long, n long, k long, l long, i long, c long"), "postings")


def _near(a: str, b: str, percent: int):
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """Of the saved pairs (a, b) of sets those with enough in common, by the whole texts of one document of each. texts has one row of each name."""
    one = classes.select(F.col("set_id").alias("_set"), F.col("first_doc").alias("_doc"), F.col("first_key").alias("_hash"))

    def with_text(table: DataFrame, column: str, out: str) -> DataFrame:
        named = save(table.join(one, F.col(column) == F.col("_set")).drop("_set"), f"{name}_{out}")
        return _named(texts, broadcast_if_small(named)).drop("_id", "_key").withColumnRenamed("text", out)

    @tidy
    def check(batches):
        def sets(column):
            out = []
            for _, _, keys, offsets in shingle_sets(column, size):
                ids = _ids(keys, offsets).tolist()
                out += [(i, keys[x:y]) for i, x, y in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist())]
            return out

        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            change = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
            left, right, at = sets(batch.column(2).filter(pa.array(change))), sets(batch.column(3)), np.cumsum(change) - 1
            keep = np.zeros(len(a), bool)
            for i in range(len(a)):
                (one_id, x), (other_id, y) = left[at[i]], right[i]
                if one_id == a[i] and other_id == b[i]:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    x = with_text(pairs.select("a").distinct(), "a", "x").withColumnRenamed("a", "_a")
    y = with_text(pairs.select("a", "b"), "b", "y")
    return save(y.join(x, F.col("a") == F.col("_a")).select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), name)


def first_links(low: DataFrame, labels: DataFrame | None, texts: DataFrame, classes: DataFrame, size: int, percent: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Hold each set against one other: of the lists of its smallest tokens, the member with the most common tokens that it meets most. With labels from before, others are chosen, and only of other components. Returns links and their components."""
    if labels is not None:
        low = low.join(labels, F.col("set_id") == F.col("node"), "left").withColumns({"c": F.coalesce("label", "set_id"), "common": F.col("common").bitwiseAND(F.lit(~15)) * 65536 + F.pmod(F.xxhash64("set_id"), F.lit(65536))})
    else:
        low = low.withColumn("c", F.col("set_id"))
    lists = low.groupBy("token").agg(F.max(F.struct("common", "set_id", "n", "c")).alias("p"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select(F.col("token").alias("_token"), F.col("p.set_id").alias("a"), F.col("p.n").alias("n_a"), F.col("p.c").alias("c_a"))
    star = low.join(lists, F.col("token") == F.col("_token")).where((F.col("c") != F.col("c_a")) & _near("n", "n_a", percent))
    star = star.groupBy("a", F.col("set_id").alias("b")).agg(F.count("*").alias("c"), F.first(F.least("n", "n_a")).alias("least")).where(F.col("c") >= F.least(F.lit(LOWEST_SHARED), "least"))
    star = save(star.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")), f"{name}_pairs")
    links = verified(star, texts, classes, size, percent, name)
    return links, components(links, name) if labels is None else labels


def with_main(found: DataFrame) -> DataFrame:
    """The postings of tokens that different components have, with the component of each token's smallest set (main) and whether the list is long."""
    lists = found.groupBy("token").agg(F.min(F.struct("set_id", "c")).alias("p"), F.min("c").alias("low"), F.max("c").alias("high"), (F.count("*") >= LONG).alias("long")).where("low < high")
    lists = lists.select(F.col("token").alias("_token"), F.col("p.c").alias("main"), "long")
    return found.join(lists, F.col("token") == F.col("_token")).drop("_token")


def sketched(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Postings with the sketch of their set and its token before (in the order of tokens)."""
    before = F.lag("token").over(Window.partitionBy("set_id").orderBy("token"))
    return found.withColumn("before", before).join(classes.select(F.col("set_id").alias("_set"), "sketch"), F.col("set_id") == F.col("_set")).drop("_set")


def differences(a: str, b: str) -> Column:
    """How many bits two sketches differ in; one twice as long as the other is folded to its length."""

    def fitted(x: str, y: str) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        folded = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > F.size(y), folded).otherwise(F.col(x))

    bits = F.zip_with(fitted(a, b), fitted(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda total, x: total + x)


def matches(found: DataFrame, percent: int) -> DataFrame:
    """Postings that two sets in different components share and that don't rule out that the sets link, from with_main.

    Linked sets differ in at most (n + m) * (100 - percent) / (100 + percent)
    tokens. A shared token at places i and j leaves at least |i - j| differences
    before it and |(n - i) - (m - j)| after it. A pair that shares no rare token
    differs in all its k rare ones, so it meets in a frequent token's list only
    if those are few, and one of them has few for its size; so sets that share a
    very common passage and little else aren't paired. With sketches two sets
    meet only if these differ in few enough bits, and only in tokens before which
    they don't share the token before, as they meet there already.
    """
    more = [x for x in ("before", "sketch") if x in found.columns]
    rare = F.col("token") < _OFTEN_BIT
    found = found.withColumn("few", rare | (2 * percent * F.col("k") <= (100 - percent) * F.col("n")) | (F.col("n") == CAP))
    minor = found.where("c != main").select(*[F.col(x).alias(f"{x}_a") for x in ("token", "set_id", "c", "few", *_NUMBERS, *more)])
    large = (F.col("n") == CAP) | (F.col("n_a") == CAP)
    room = (100 - percent) * (F.col("n") + F.col("n_a"))
    apart = F.abs(F.col("i") - F.col("i_a")) + F.abs(F.col("n") - F.col("i") - F.col("n_a") + F.col("i_a"))
    once = (F.col("c_a") != F.col("c")) & ((F.col("c") == F.col("main")) | (F.col("set_id_a") < F.col("set_id")))
    may = large | (((100 + percent) * apart <= room) & (rare | ((100 + percent) * (F.col("k") + F.col("k_a")) <= room)))
    on = (F.col("token_a") == F.col("token")) & once & _near("n_a", "n", percent) & may
    if more:
        on = on & F.coalesce((F.col("before") != F.col("before_a")) | (F.col("before") == F.col("token")), F.lit(True)) & (large | ((100 + percent) * differences("sketch_a", "sketch") <= room))
    met = minor.where("few_a").join(found, on).unionByName(minor.where("not few_a").join(found.where("few"), on))
    return met.withColumns({"room": room, "large": large})


def cross_pairs(found: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets in different components that may link, from with_main.

    Either they meet in a long list and their sketches are near, or they share
    as many prefix tokens in short lists as the smaller l, and of their tokens up
    to the last match few enough don't match. A pair whose shared tokens all lie
    in short lists is counted in full there; any other is met in the long ones.
    """
    a, b = F.least("set_id_a", "set_id").alias("a"), F.greatest("set_id_a", "set_id").alias("b")
    near = matches(sketched(found.where("long"), classes), percent).select(a, b)
    first = F.col("set_id_a") < F.col("set_id")  # which of the two is a differs from token to token
    places = F.max(F.when(first, F.col("i_a")).otherwise(F.col("i"))) + F.max(F.when(first, F.col("i")).otherwise(F.col("i_a")))
    each = matches(found.where("not long"), percent).groupBy(a, b).agg(F.count("*").alias("shared"), F.first(F.least("l_a", "l")).alias("need"), (places + 2).alias("seen"), F.first("room").alias("room"), F.first("large").alias("large"))
    each = each.where((F.col("shared") >= F.col("need")) & (F.col("large") | ((100 + percent) * (F.col("seen") - 2 * F.col("shared")) <= F.col("room")))).select("a", "b")
    return near.unionByName(each).distinct()


def _name(doc: str, key: str):
    """Orders rows by doc_id, null ids last, and then by the hash of the text."""
    return F.struct(F.col(doc).isNull().alias("none"), F.col(doc).alias("doc"), F.col(key).alias("key"))


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Link documents whose sets of word shingles have 100 * intersection >= percent * union: doc_id, n_shingles, component_id.

    Equal sets are one set. Two rounds hold each set against one other that
    has much of its smallest tokens, the first of their lists; what links becomes
    components, so a group of near copies costs about as many checks as members.
    Then all pairs of sets in different components that share as many prefix
    tokens as the smaller of their numbers says, or a token of a long list and
    have near sketches, are checked, so no link between components is missed. component_id is the smallest doc_id that links reach. A
    null, empty or blank text has 0 shingles and links with nothing; equal rows
    are linked; rows with equal doc_id are documents of their own; an empty table
    gives no row.
    """
    return named_components(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def named_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """jaccard_components with key, the hash of each row's text, and component_key, that of the text of the component's first row."""
    with text_batches(docs.sparkSession):
        return _named_components(docs, size, percent)


def _named_components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    texts = named_texts(docs)
    profile = profiles(texts, size)
    each = profile.where("n is not null").select("doc_id", "key", "set_id", "n")
    texts = _once(texts, save(each.where("n > 0").groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_hash")).count().where("count > 1").drop("count"), "repeated"), "repeated_texts")
    documents, total = each.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    classes = save(profile.where("n > 0").groupBy("set_id").agg(F.min(_name("doc_id", "key")).alias("first"), F.first("n").alias("n"), F.first("lowest").alias("lowest"), F.first("sketch").alias("sketch"), F.max("common").alias("common")).select("*", F.col("first.doc").alias("first_doc"), F.col("first.key").alias("first_key")).drop("first"), "classes")

    low = save(classes.select(F.explode("lowest").alias("token"), "set_id", "n", "common"), "lowest")
    links, labels = first_links(low, None, texts, classes, size, percent, "star")
    more, labels = first_links(low, labels, texts, classes, size, percent, "second")
    links = links.unionByName(more)
    labels = components(links, "both")

    known = save(classes.join(labels, F.col("set_id") == F.col("node"), "left").select(F.col("first_doc").alias("_doc"), F.col("first_key").alias("_hash"), "set_id", F.coalesce("label", "set_id").alias("c")), "labelled")
    found = postings(_named(texts, broadcast_if_small(known)).select("text", "set_id", "c"), _frequent(profile, documents), total, size, percent).distinct()
    mixed = save(with_main(found), "mixed_postings")
    more = verified(save(cross_pairs(mixed, classes, percent), "cross_pairs"), texts, classes, size, percent, "cross")
    labels = components(links.unionByName(more), "links")

    label = F.coalesce("label", "set_id").alias("label")
    where = save(classes.join(labels, F.col("set_id") == F.col("node"), "left").select("set_id", label, "first_doc", "first_key"), "class_labels")
    first = where.groupBy("label").agg(F.min(_name("first_doc", "first_key")).alias("first"))
    named = save(where.join(first, "label").select(F.col("set_id").alias("_set"), F.col("first.doc").alias("component_id"), F.col("first.key").alias("component_key")), "class_components")
    out = each.join(named, (F.col("set_id") == F.col("_set")) & (F.col("n") > 0), "left")
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("_set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("component_key", "key").alias("component_key"))


def distinct_documents(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, the one with the smallest doc_id (rows without one come last, equal ids by the hash of the text, rows equal in both by a hash of the whole row), with its own columns, whatever their names. Rows whose text is null, empty or blank all stay."""
    found = save(named_components(docs, size, percent), "jaccard")
    name = [F.col("doc_id").alias("_doc"), F.col("key").alias("_hash")]
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("component_key"))
    gone = found.where((F.col("n_shingles") > 0) & ~first).select(*name).distinct()
    twice = save(found.where((F.col("n_shingles") > 0) & first).groupBy(*name).count().where("count > 1").drop("count"), "kept_twice")
    boxes = in_boxes(docs, F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_key"))
    left = _named(boxes, gone, "left_anti")
    if not twice.isEmpty():
        one = _named(left, twice, "left_semi").groupBy("_id", "_key").agg(F.min_by("box", F.md5(F.to_json("box"))).alias("box"))
        left = _named(left, twice, "left_anti").select("box").unionByName(one.select("box"))
    return left.select("box.*")


def op9_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
