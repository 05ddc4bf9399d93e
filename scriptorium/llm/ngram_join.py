"""Exact Jaccard self-join on word n-grams by partitioning the universe of n-grams.

Two sets of Jaccard similarity t differ in at most H elements, H following from their sizes.
N-grams are hashed into m > H segments, so two linked sets agree in at least m - H segments:
they share the signature of a segment.  The number of segments is fixed by the size band of
the larger set; a set also emits signatures for the next band where a partner may lie there.

Signatures cost what others share them, so allocation is by frequency.  With m - H agreeing
segments a set may leave m - H - 1 unprobed: first its empty ones, then the most frequent, in
one order for all sets, so that linked sets still share a probed one.  A set with more empty
segments than it may leave takes the one-deletion neighbourhoods as well (a segment less one
n-gram), which find segments with one difference: an agreeing segment counts twice, one with
one difference once, and linked sets reach 2m - H together.  Only sets whose empty segments and
frequent neighbourhoods alone could reach that sum are joined on these, against each other.

Sets that share fewer signatures than any link needs leave first.  Within a signature's sets all are verified against the one that shares most signatures; where that leaves sets in
different components, the rest is verified too, but for pairs that the triangle inequality of
the Jaccard distance rules out: as pairs where few are outside the largest component, else its
sets meet in slices and only links leave a task.  Equal sets are one node from the start.  Every link between
different sets is found or lies inside a component that verified links connect.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import blocks, over_batches, over_streams, shuffle_partitions, stored
from scriptorium.llm.components import components, open_pairs, reach, unresolved_members, with_leaders

WORDS = 4
PERCENT = 85
#: A signature that more sets share is frequent.
FREQUENT = 64
#: Bytes of a slice of a signature's open sets, about; two slices meet in memory.
SLICE_BYTES = 8 << 20
#: Text of one pass over n-grams, whose arrays are some forty times as large.
BLOCK_BYTES = 512 << 10
#: Growth of size bands.
RATIO = 1.6
SPARE = "array<struct<band:int,n:int>>"

_U = np.uint64
_SEED = np.random.default_rng(20_240_607)
_BYTES = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x5851F42D4C957F2D)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def ngram_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The set of hashed word n-grams of each text, sorted.

    A-Z become lower case; words are runs without ASCII white space; a text with fewer words
    than ``words`` has its whole sequence as one n-gram; no word, no n-gram.
    """
    column = texts.fill_null("").cast(pa.large_string()) if texts.null_count else texts.cast(pa.large_string())
    cuts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or cuts[-1] == cuts[0]:
        return [np.zeros(0, _U)] * len(column)
    data = np.frombuffer(column.buffers()[2], np.uint8)[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    solid = ~_BLANK[data]
    fresh = np.zeros(len(data) + 1, bool)  # a text begins here
    fresh[cuts] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | fresh[1:-1]
    starts = np.flatnonzero(starts)
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | fresh[1:-1]
    ends = np.flatnonzero(ends) + 1
    power = np.full(len(data), _BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTES[_LOWER[data]] * power, out=sums[1:])
    back = np.full(len(data), _BASE_INVERSE)
    back[0] = 1
    back = np.multiply.accumulate(back)
    word = mix((sums[ends] - sums[starts]) * back[starts])
    first = np.searchsorted(starts, cuts)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if a == b:
            out.append(np.zeros(0, _U))
            continue
        width = min(words, b - a)
        gram = np.full(b - a - width + 1, _U(width))
        for i in range(width):
            gram = gram * _U(0x9E3779B97F4A7C15) + word[a + i : b - width + 1 + i]
            gram ^= gram >> _U(29)
        gram = np.sort(mix(gram))
        keep = np.ones(len(gram), bool)
        np.not_equal(gram[1:], gram[:-1], out=keep[1:])
        out.append(gram[keep])
    return out


def identity(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, signed."""
    one = mix(tokens ^ _U(0x243F6A8885A308D3)).sum(dtype=_U)
    two = mix(tokens + _U(0x13198A2E03707344)).sum(dtype=_U)
    return int(mix(np.array([one]))[0].astype(np.int64)), int(mix(np.array([two]))[0].astype(np.int64))


class Partition:
    """Size bands and their segments for a similarity in percent."""

    def __init__(self, percent: int = PERCENT, ratio: float = RATIO):
        self.percent = percent
        self.low = [1]
        while self.low[-1] < 1 << 33:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * ratio)))
        self.low = self.low[:64]

    def differing(self, total: int) -> int:
        """The most elements in which two linked sets of ``total`` elements together differ."""
        return (100 - self.percent) * total // (100 + self.percent)

    def bands(self, size: int) -> list[tuple[int, int, int]]:
        """(band, segments, most differing elements of this set's links) that a set takes part
        in; none where only equal sets link."""
        partner = 100 * size // self.percent if self.percent else size
        own = int(np.searchsorted(self.low, size, "right")) - 1
        out = []
        for band in range(own, len(self.low) - 1):
            if self.low[band] > max(partner, size):
                break
            most = self.differing(2 * (self.low[band + 1] - 1))
            if most:
                reach = min(partner, self.low[band + 1] - 1)
                out.append((band, most + 1 + -(-most // 8), self.differing(size + reach)))
        return out

    @staticmethod
    def segments(tokens: np.ndarray, band: int, m: int) -> np.ndarray:
        """The segment of every element."""
        spread = mix(tokens ^ _U(0xA4093822299F31D0 + band))
        return ((spread >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)

    @staticmethod
    def keys(sums: np.ndarray, segment: np.ndarray, band: int) -> np.ndarray:
        """Signatures from sums of hashed elements; the low six bits are the band."""
        mixed = mix(sums ^ mix(segment.astype(_U) + _U((band + 1) << 40)))
        return ((mixed & ~_U(63)) | _U(band)).view(np.int64)


def _signatures(part: Partition, tokens: np.ndarray, band: int, m: int):
    """(keys, segments) of the segments that are not empty."""
    segment = part.segments(tokens, band, m)
    order = np.argsort(segment, kind="stable")
    there = segment[order]
    begin = np.flatnonzero(np.r_[True, there[1:] != there[:-1]])
    sums = np.add.reduceat(mix(tokens[order]), begin)
    return part.keys(sums, there[begin], band), there[begin]


def profile(rows: DataFrame, words: int, part: Partition) -> DataFrame:
    """``doc_id``, ``n`` (set size), ``a`` and ``b`` (identity), ``spare`` (per band, how many of the
    segments that are not empty may go unprobed) and ``thin``: some band has none to spare, its
    empty segments are too many to rely on signatures alone."""

    def begin():
        def each(batch):
            for block in blocks(batch, "text", BLOCK_BYTES):
                sets = ngram_sets(block.column("text"), words)
                ids = [identity(s) for s in sets]
                spare = [
                    [{"band": band, "n": _spare(part, s, band, m, most)} for band, m, most in part.bands(len(s))]
                    for s in sets
                ]
                yield {
                    "doc_id": block.column("doc_id"),
                    "n": [len(s) for s in sets],
                    "a": [i[0] for i in ids],
                    "b": [i[1] for i in ids],
                    "spare": spare,
                    "thin": [any(e["n"] < 0 for e in s) for s in spare],
                }

        return each

    schema = f"doc_id long, n long, a long, b long, spare {SPARE}, thin boolean"
    return over_batches(rows, begin, schema)


def _spare(part: Partition, tokens: np.ndarray, band: int, m: int, most: int) -> int:
    """How many further segments may go unprobed."""
    return m - most - 1 - (m - len(np.unique(part.segments(tokens, band, m))))


def _linkable(shared: DataFrame, need: DataFrame) -> DataFrame:
    """The rows of ``shared`` (``key``, ``a``) of sets that share enough signatures to link at all.

    A linked set shares one more than it may leave unprobed (``need``: ``a``, ``band``, ``need``).
    Without the other sets, a signature may have one set left; so twice.
    """
    for _ in range(2):
        rows = shared.withColumn("band", F.col("key").bitwiseAND(63).cast("int"))
        enough = rows.groupBy("a", "band").agg(F.count("*").alias("n")).join(need, ["a", "band"]).where("n >= need")
        rows = rows.join(enough.select("a", "band"), ["a", "band"], "left_semi")
        keys = rows.groupBy("key").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low < high")
        shared = rows.join(keys.select("key"), "key", "left_semi").select("key", "a")
    return shared


def shared_signatures(rows: DataFrame, words: int, part: Partition) -> DataFrame:
    """``key`` and ``a``: the signatures that at least two different sets have, each once a set."""

    def begin():
        def each(batch):
            for block in blocks(batch, "text", BLOCK_BYTES):
                keys, owners = [], []
                for s in ngram_sets(block.column("text"), words):
                    if len(s):
                        found = [_signatures(part, s, band, m)[0] for band, m, _ in part.bands(len(s))]
                        if found:
                            keys += found
                            owners.append(np.full(sum(map(len, found)), identity(s)[0]))
                if keys:
                    yield {"key": pa.array(np.concatenate(keys)), "a": pa.array(np.concatenate(owners))}

        return each

    def run(batches):
        held = np.zeros((0, 2), np.int64)  # the last row so far, and whether it is already out
        out_already = False
        for batch in batches:
            now = np.stack([batch.column("key").to_numpy(), batch.column("a").to_numpy()], 1)
            now = np.concatenate([held, now])
            new = np.r_[True, (now[1:] != now[:-1]).any(1)]
            now = now[new]
            twin = np.zeros(len(now), bool)
            twin[1:] = now[1:, 0] == now[:-1, 0]
            same = twin.copy()
            same[:-1] |= twin[1:]
            if out_already:
                now_out, same_out = now[1:], same[1:]
            else:
                now_out, same_out = now, same
            found = now_out[same_out]
            out_already = bool(same[-1]) if len(now) > 1 else out_already
            held = now[-1:]
            if len(found):
                yield {"key": found[:, 0], "a": found[:, 1]}

    emitted = over_batches(rows.select("text"), begin, "key long, a long")
    together = emitted.repartition(shuffle_partitions(rows.sparkSession), "key").sortWithinPartitions("key", "a")
    return over_streams(together, run, "key long, a long")


def _deletions(sets: DataFrame, part: Partition) -> DataFrame:
    """Signatures and one-deletion neighbourhoods of sets (``node``, ``tokens``), in the bands where
    empty segments are more than may go unprobed.

    Rows: ``key``, ``node``, ``band``, ``segment``, ``weight`` (2 for the whole segment, 1 for a
    segment less one), ``void`` (nothing is left in it) and ``need``, the sum that links reach.
    """

    def begin():
        def each(batch):
            for node, data in zip(batch.column("node").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                tokens = np.frombuffer(data, _U)
                for band, m, most in part.bands(len(tokens)):
                    segment = part.segments(tokens, band, m)
                    count = np.bincount(segment, minlength=m)
                    if m - most - 1 - int((count == 0).sum()) >= 0:
                        continue
                    hashed = mix(tokens)
                    sums = np.zeros(m, _U)
                    np.add.at(sums, segment, hashed)
                    every = np.r_[np.arange(m), segment]
                    keys = part.keys(np.r_[sums, sums[segment] - hashed], every, band)
                    yield {
                        "key": keys,
                        "node": np.full(len(keys), node),
                        "band": np.full(len(keys), band, np.int32),
                        "segment": every.astype(np.int32),
                        "weight": np.r_[np.full(m, 2, np.int32), np.ones(len(segment), np.int32)],
                        "void": np.r_[count == 0, count[segment] == 1],
                        "need": np.full(len(keys), 2 * m - most, np.int32),
                    }

        return each

    schema = "key long, node long, band int, segment int, weight int, void boolean, need int"
    return over_batches(sets.select("node", "tokens"), begin, schema)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (``x``, ``y``) with ``common``, ``nx`` and ``ny``."""
    left = sets.select(F.col("node").alias("x"), F.col("tokens").alias("tx"))
    right = sets.select(F.col("node").alias("y"), F.col("tokens").alias("ty"))

    def begin():
        def each(batch):
            common, nx, ny = [], [], []
            for one, two in zip(batch.column("tx").to_pylist(), batch.column("ty").to_pylist(), strict=True):
                one, two = np.frombuffer(one, _U), np.frombuffer(two, _U)
                at = np.searchsorted(two, one)
                at[at == len(two)] = 0
                common.append(int((two[at] == one).sum()) if len(two) else 0)
                nx.append(len(one))
                ny.append(len(two))
            yield {"x": batch.column("x"), "y": batch.column("y"), "common": common, "nx": nx, "ny": ny}

        return each

    both = pairs.join(left, "x").join(right, "y").select("x", "y", "tx", "ty")
    return over_batches(both, begin, "x long, y long, common long, nx long, ny long")


def _open_links(members: DataFrame, sets: DataFrame, percent: int, slice_bytes: int) -> DataFrame:
    """Links (``a``, ``b``) that connect what is linked among the ``members`` of each signature.

    A signature's members are cut into slices, and each pair of slices meets in one task: as
    many copies of a member as its signature has slices.  A link inside one component, old or
    made by a link before it, is not looked for.
    """
    cut = members.groupBy("tier", "key").agg(F.ceil(F.sum("size") * 8 / slice_bytes).cast("int").alias("slices"))
    sliced = members.join(cut, ["tier", "key"]).withColumn(
        "slice", F.pmod(F.xxhash64("node"), F.greatest("slices", F.lit(1))).cast("int")
    )
    # Cell (i, j), i <= j, holds slices i and j.
    other = F.explode(F.sequence(F.lit(0), F.greatest("slices", F.lit(1)) - 1)).alias("other")
    cell = ["tier", "key", "i", "j"]
    dealt = (
        sliced.select("*", other)
        .withColumns({"i": F.least("slice", "other"), "j": F.greatest("slice", "other")})
        .join(sets.select("node", "tokens"), "node")
        .select(*cell, "slice", "node", "component", "far", "tokens")
        .repartition(shuffle_partitions(members.sparkSession), *cell)
        .sortWithinPartitions(*cell)
    )

    def run(batches):
        held, at = [], None
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in cell], 1)
            cuts = np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)], strict=True):
                if begin == end:
                    continue
                if held and at != tuple(where[begin]):
                    yield _cell_links(pa.Table.from_batches(held), at[2] == at[3], percent)
                    held = []
                at = tuple(where[begin])
                held.append(batch.slice(begin, end - begin))
        if held:
            yield _cell_links(pa.Table.from_batches(held), at[2] == at[3], percent)

    return over_streams(dealt, run, "a long, b long")


def _cell_links(rows: pa.Table, one: bool, percent: int) -> dict:
    """Links of a cell's rows: of all with each other (``one``), or of either slice with the other."""
    node, side, far = (rows.column(c).to_numpy() for c in ("node", "slice", "far"))
    _, part = np.unique(rows.column("component").to_numpy(), return_inverse=True)
    tokens = [np.frombuffer(t.as_buffer(), _U) for t in rows.column("tokens")]
    size = np.array([len(t) for t in tokens])
    starts = np.r_[0, np.cumsum(size)[:-1]]
    main = np.bincount(part).argmax()
    ranks = None
    left = np.ones(len(node), bool)  # rows whose pairs are not all settled
    out = {"a": [], "b": []}
    for x in np.flatnonzero(part != main).tolist():
        left[x] = False
        may = left & (part != part[x]) & (np.abs(far - far[x]) <= reach(percent))
        may &= 100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x])
        if not one:
            may &= side != side[x]
        asked = np.flatnonzero(may)
        if not len(asked):
            continue
        if ranks is None:
            values, ranks = np.unique(np.concatenate(tokens), return_inverse=True)
            mine = np.zeros(len(values), np.int64)
        mine[ranks[starts[x] : starts[x] + size[x]]] = 1
        lengths = size[asked]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(starts[asked] - (ends - lengths), lengths)
        common = np.add.reduceat(mine[ranks[at]], ends - lengths)
        mine[ranks[starts[x] : starts[x] + size[x]]] = 0
        linked = asked[100 * common >= percent * (size[x] + lengths - common)]
        parts, first = np.unique(part[linked], return_index=True)
        out["a"] += [int(node[x])] * len(parts)
        out["b"] += node[linked[first]].tolist()
        part[np.isin(part, parts)] = part[x]
    return out


def _probed(shared: DataFrame, need: DataFrame) -> DataFrame:
    """``shared`` (``key``, ``a``) without the signatures that a set leaves unprobed: its most frequent
    ones, as many as it has to spare.

    The order by frequency, then key, is the same for all sets.  Linked sets share more
    signatures than either may leave out, so the least frequent one of these stays in both.
    """
    sizes = shared.groupBy("key").agg(F.count("*").alias("sets"))
    order = Window.partitionBy("a", "band").orderBy(F.desc("sets"), "key")  # at most a set's segments
    ranked = (
        shared.join(sizes, "key")
        .withColumn("band", F.col("key").bitwiseAND(63).cast("int"))
        .withColumn("rank", F.row_number().over(order))
    )
    least = need.groupBy("a", "band").agg(F.min("need").alias("need"))
    return ranked.join(least, ["a", "band"]).where("rank >= need").select("key", "a")


def jaccard_components(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    frequent: int = FREQUENT,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row.

    Two rows link when 100 * intersection >= ``percent`` * union of their n-gram sets; the
    component is the least id reachable, the row's own included.  Rows without words (null,
    empty, blank) have an empty set and link with nothing.  Rows with a null id are returned
    with a null component and link nothing; rows with equal ids are one node if their sets are
    equal, and share the id otherwise.  An empty table gives an empty one.
    """
    part = Partition(percent)
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    each = stored(profile(rows, words, part), "profile")
    full = each.where("n > 0 and doc_id is not null")
    classes = stored(
        full.groupBy("a", "b").agg(
            F.min("doc_id").alias("node"), F.first("n").alias("n"), F.max("thin").alias("thin"), F.first("spare").alias("spare")
        ),
        "classes",
    )
    every = stored(shared_signatures(rows.where("doc_id is not null"), words, part), "shared")
    need = classes.select("a", F.explode("spare").alias("e")).select("a", "e.band", (F.col("e.n") + 1).alias("need"))
    shared = stored(_linkable(every, need), "linkable")
    named = classes.select("node", "a", "b", "thin")
    asked = named.join(shared.select("a").distinct(), "a", "left_semi").select("node", "a", "b")
    asked = asked.union(named.where("thin").select("node", "a", "b")).distinct()

    def begin():
        def take(batch):
            for block in blocks(batch, "text", BLOCK_BYTES):
                sets = ngram_sets(block.column("text"), words)
                wanted = zip(block.column("node").to_pylist(), block.column("a").to_pylist(),
                             block.column("b").to_pylist(), sets, strict=True)
                kept = [(n, a, s) for n, a, b, s in wanted if identity(s) == (a, b)]
                yield {
                    "node": [k[0] for k in kept],
                    "a": [k[1] for k in kept],
                    "tokens": [k[2].tobytes() for k in kept],
                }

        return take

    texts = rows.join(asked, rows["doc_id"] == asked["node"]).select("node", "a", "b", "text")
    # Rows with equal ids and texts come more than once; what follows counts none of them twice.
    sets = stored(over_batches(texts, begin, "node long, a long, tokens binary"), "sets")
    members = stored(
        _probed(shared, need).join(classes.select("a", "node"), "a").select("key", "node").distinct(), "members"
    )
    thin = sets.join(classes.where("thin").select("node").distinct(), "node", "left_semi")
    deleted = stored(_deletions(thin, part), "deletions")
    counted = deleted.groupBy("key").agg(F.count("*").alias("sets"))
    crowded = counted.where(F.col("sets") > frequent).select("key", F.lit(True).alias("crowded"))
    judged = deleted.join(crowded, "key", "left").withColumn(
        "costly", F.col("void") | F.coalesce("crowded", F.lit(False))
    )
    lost = (
        judged.groupBy("node", "band", "segment")
        .agg(F.max(F.when(F.col("costly"), F.col("weight")).otherwise(0)).alias("lost"), F.first("need").alias("need"))
        .groupBy("node", "band")
        .agg(F.sum("lost").alias("lost"), F.first("need").alias("need"))
        .where("lost >= need")
        .select("node", "band")
    )
    buckets = stored(
        members.select(F.lit(0).alias("tier"), "key", "node")
        .union(judged.where("not costly").select(F.lit(1), "key", "node"))
        .union(judged.where("costly").join(lost, ["node", "band"]).select(F.lit(2), "key", "node"))
        .distinct(),
        "buckets",
    )
    # A set that shares many signatures is near to many sets.
    weight = members.groupBy("node").agg(F.count("*").alias("weight"))
    weighed = buckets.join(weight, "node", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    led = stored(with_leaders(weighed, ["tier", "key"]), "led")
    star = led.where("node != lead").select(F.col("node").alias("x"), F.col("lead").alias("y")).distinct()
    checked = stored(_verified(star, sets), "checked")
    linked = F.expr(f"100 * common >= {percent} * (nx + ny - common)")
    links = checked.where(linked).select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = stored(components(links), "components")
    rest = stored(unresolved_members(led, checked, found, percent), "open")
    crowded = _open_links(rest.where("crowded"), sets, percent, slice_bytes)
    few = _verified(open_pairs(rest, percent), sets).where(linked).select(F.col("x").alias("a"), F.col("y").alias("b"))
    more = stored(crowded.union(few), "rest")
    if more.head(1):
        found = stored(components(links.union(more)), "components")
    placed = classes.join(found, "node", "left").select(
        "a", "b", F.coalesce("component", "node").alias("component")
    )
    linked_rows = full.select("doc_id", "n", "a", "b").join(placed, ["a", "b"]).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )
    alone = each.where("n = 0 or doc_id is null").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    return linked_rows.union(alone)
