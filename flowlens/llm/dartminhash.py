"""MinHash near-dedup with DartMinHash: weighted signatures from darts, bands, exact verification, connected classes.

A document is the bag of its five-word shingles; the weight of a shingle is how often it occurs. Each shingle owns a
plane (weight x rank) into which hashed darts fall at unit rate, in cells of dyadic width: cell ``(v, r)`` spans
weights ``[2^v - 1, 2^(v+1) - 1)`` and ranks ``[r, r + 1) * 2^-v``. A dart counts for a document if its weight is under the
document's weight of that shingle. Darts are numbered off to ``BANDS * ROWS`` coordinates, and each coordinate keeps the
dart of the lowest rank: the probability that two documents agree in a coordinate is their weighted Jaccard similarity.
Only ranks up to about ``t / total weight`` are looked at, with ``t = k ln k + 2 k`` darts expected; a document with an
empty coordinate looks at twice the range.

Bands of ``ROWS`` coordinates are the join keys. Identity is the bag itself (its 128-bit hash), the id is only a name: texts with the
same bag are one representative, so a large group of copies is one row. Inside a bucket every member is held against one
hub (a star, not all pairs), classes are formed, and buckets that still hold more than one class go on with another
hub. Members of buckets that are mixed even then are joined exactly among themselves: shingles in the order of their frequency,
prefixes per class of partner sizes, positions as a bound. A member whose rare shingles are its own meets nobody there,
so a large group of graded texts costs what its links cost, not its square. Verified links and the members of a
class are never dropped or capped. A link is exact: the weighted Jaccard similarity of the two bags is at least 0.8.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import cut, prepare
from flowlens.llm.tokens import ALNUM, mixed, words_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 6
#: Rounds with one hub per bucket; what is left then is joined over its rare shingles.
HUBS = 2
#: Ratio of the largest to the smallest size of one class of partner sizes.
SIZES = 1.05

_SEED = np.uint64(0xD6E8FEB86659FD93)
#: Chances of at most 0, 1, ... darts in a cell of area 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def bags(texts: pa.Array):
    """Per text the distinct shingle hashes, ascending, and their counts. Fewer than five words are one short shingle."""
    for low, high, words in words_of(texts, ALNUM, lower=True):
        value, at = words.shingles(SHINGLE)
        ends = np.searchsorted(at, words.first)
        for i in range(high - low):
            own = value[ends[i]: ends[i + 1]]
            if not len(own) and words.count[i]:
                short = words.hash[words.first[i]: words.first[i + 1]]
                own = mixed(np.array([np.bitwise_xor.reduce(mixed(short + np.arange(len(short), dtype=np.uint64)))]))
            yield np.unique(own, return_counts=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def _darts(items: np.ndarray, weights: np.ndarray, reach: float):
    """Rank and identity of the darts under the weights with ranks up to ``reach``."""
    ranks, names = [], []
    for v in range(int(weights.max() + 1).bit_length()):
        some = items[weights > 2 ** v - 1] if v else items
        limit = weights[weights > 2 ** v - 1] if v else weights
        if not len(some):
            break
        cells = math.ceil(reach * 2 ** v)
        row = np.repeat(np.arange(len(some)), cells)
        r = np.tile(np.arange(cells), len(some))
        cell = mixed(some[row] + _SEED * (r.astype(np.uint64) * np.uint64(64) + np.uint64(v + 1)))
        u = _unit(cell)
        count = np.zeros(len(cell), np.int64)
        for chance in _POISSON:
            more = u > chance
            if not more.any():
                break
            count += more
        at = np.repeat(np.arange(len(cell)), count)
        number = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        name = mixed(cell[at] ^ mixed(number.astype(np.uint64) + np.uint64(1)))
        rank = (r[at] + _unit(mixed(name + _SEED))) * 2.0 ** -v
        weight = 2 ** v - 1 + _unit(mixed(name ^ _SEED)) * 2 ** v
        keep = (rank <= reach) & (weight < limit[row[at]])
        ranks.append(rank[keep])
        names.append(name[keep])
    return np.concatenate(ranks), np.concatenate(names)


def signature(items: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates of a non-empty bag."""
    reach = (size * math.log(size) + 2 * size) / weights.sum()
    while True:
        rank, name = _darts(items, weights, reach)
        coordinate = (mixed(name + np.uint64(5)) % np.uint64(size)).astype(np.int64)
        order = np.lexsort((rank, coordinate))
        first, at = np.unique(coordinate[order], return_index=True)
        if len(first) == size:
            return name[order][at]
        reach *= 2


def band_keys(items: np.ndarray, weights: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band."""
    table = signature(items, weights, bands * rows).reshape(bands, rows)
    key = mixed(np.arange(bands, dtype=np.uint64) + _SEED)
    for j in range(rows):
        key = mixed(key ^ table[:, j])
    return key.view(np.int64)


def similarity(a, b) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


def signed(docs: DataFrame) -> DataFrame:
    """``_row, _bag, _size, _keys`` of ``_row, _text``: 128-bit hash of the bag (null for no words), weight and band keys."""
    def run(batches):
        for batch in batches:
            names, sizes, keys = [], [], []
            for items, counts in bags(batch.column(1)):
                if len(items):
                    both = mixed(items * np.uint64(3) + mixed(counts.astype(np.uint64)))
                    names.append(np.array([both.sum(), mixed(both + _SEED).sum()], ">u8").tobytes())
                    sizes.append(int(counts.sum()))
                    keys.append(band_keys(items, counts))
                else:
                    names.append(None)
                    sizes.append(0)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))], ["_row", "_bag", "_size", "_keys"])
    kind = docs.schema["_row"].dataType.simpleString()
    return docs.mapInArrow(run, f"_row {kind}, _bag binary, _size long, _keys array<long>")


def tokens(texts: DataFrame) -> DataFrame:
    """``_rep, _t`` of ``_rep, _text``: one token per shingle and occurrence, so that bags are sets of tokens."""
    def table(owners, found):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(owners)), pa.array(np.concatenate(found).view(np.int64))], ["_rep", "_t"])

    def run(batches):
        for batch in batches:
            owners, found, held = [], [], 0
            for rep, (items, counts) in zip(batch.column(0).to_pylist(), bags(batch.column(1)), strict=True):
                number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                found.append(mixed(np.repeat(items, counts) + _SEED * number.astype(np.uint64)))
                owners.append(np.full(len(number), rep, np.int64))
                held += len(number)
                if held > 1 << 18:
                    yield table(owners, found)
                    owners, found, held = [], [], 0
            if owners:
                yield table(owners, found)
    return texts.select("_rep", "_text").mapInArrow(run, "_rep long, _t long")


def _size_class(size):
    return F.floor(F.log(size.cast("double")) / F.lit(math.log(SIZES)) + F.lit(1e-9))


def rare_pairs(texts: DataFrame, placed: DataFrame, least: float) -> DataFrame:
    """``_x, _y``: all pairs of different classes in ``placed`` (``_rep, _size, _class``) that can be similar enough.

    Two sets of ``a`` and ``b`` tokens need ``c = least / (1 + least) * (a + b)`` in common, so in any fixed order they share
    one among the first ``a - c + 1`` and ``b - c + 1``. The order is by frequency, rare tokens first, and the first shared
    place bounds what can follow. Tokens of one class of partners only are left out, and where several classes meet,
    the members of the largest are not held against each other.
    """
    tiny = 1e-9
    share = least / (1 + least)
    every = cut(tokens(texts.join(placed.select("_rep"), "_rep", "left_semi")))
    often = every.groupBy("_t").agg(F.count(F.lit(1)).alias("_df")).filter("_df > 1")
    ranked = (every.join(often, "_t", "left").groupBy("_rep")
              .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("_df", F.lit(1)).alias("_df"), "_t"))).alias("_ts"))
              .join(placed, "_rep"))
    longest = F.col("_size") - F.ceil(F.lit(least) * F.col("_size") - tiny) + 1
    low, high = _size_class(F.greatest(F.ceil(F.lit(least) * F.col("_size") - tiny), F.lit(1))), _size_class(F.floor(F.col("_size") / least + tiny))
    spots = (ranked.select("_rep", "_size", "_class", F.posexplode(F.slice("_ts", F.lit(1), longest.cast("int"))).alias("_at", "_e"))
             .filter("_e._df > 1")
             .select("_rep", "_size", "_class", "_at", F.col("_e._t").alias("_t"), F.explode(F.sequence(low, high)).alias("_b")))
    # The least size of a partner of that class bounds how much must be shared with it.
    partner = F.greatest(F.ceil(F.pow(F.lit(SIZES), F.col("_b").cast("double")) * (1 - 1e-9)), F.ceil(F.lit(least) * F.col("_size") - tiny))
    needed = F.ceil(F.lit(share) * (F.col("_size") + partner) - tiny)
    own = _size_class(F.col("_size"))
    spots = (spots.filter(F.col("_at") < F.col("_size") - needed + 1)
             .select("_rep", "_size", "_class", "_at", "_t", F.least(own, "_b").alias("_b1"), F.greatest(own, "_b").alias("_b2")))
    where = ["_t", "_b1", "_b2"]
    spots = cut(spots)
    members = spots.groupBy(*where, "_class").agg(F.count(F.lit(1)).alias("_n"))
    mixed_ = members.groupBy(*where).agg(F.max(F.struct("_n", "_class")).alias("_top"), F.count(F.lit(1)).alias("_k")).filter("_k > 1")
    placed_ = spots.join(mixed_.select(*where, F.col("_top._class").alias("_most")), where)
    x = placed_.filter("_class <> _most").select(*where, F.col("_rep").alias("_x"), F.col("_size").alias("_sx"), F.col("_class").alias("_cx"),
                                                 F.col("_at").alias("_ax"))
    y = placed_.select(*[F.col(c).alias(f"{c}y") for c in where], F.col("_rep").alias("_y"), F.col("_size").alias("_sy"), F.col("_class").alias("_cy"), F.col("_at").alias("_ay"),
                       (F.col("_class") == F.col("_most")).alias("_of_most"))
    bound = 1 + F.least(F.col("_sx") - F.col("_ax") - 1, F.col("_sy") - F.col("_ay") - 1)
    fits = (F.col("_cx") != F.col("_cy")) & (bound >= F.lit(share) * (F.col("_sx") + F.col("_sy")) - tiny) & alike("_sx", "_sy", least)
    # Two members outside the largest class meet once only.
    once = F.col("_of_most") | (F.col("_x") < F.col("_y"))
    same = [F.col(c) == F.col(f"{c}y") for c in where]
    return x.join(y, [*same, fits, once]).select("_x", "_y").distinct()


def alike(a: str, b: str, least: float):
    """Can two bags of these weights be similar enough? The smaller weight bounds what they share."""
    return F.least(a, b) >= F.lit(least) * F.greatest(a, b)


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``_x, _y`` of the pairs whose texts (``_rep, _text``) are similar enough."""
    def run(batches):
        for batch in batches:
            left, right = bags(batch.column(2)), bags(batch.column(3))
            keep = [similarity(a, b) >= least for a, b in zip(left, right, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    sided = (pairs.join(texts.select(F.col("_rep").alias("_x"), F.col("_text").alias("_tx")), "_x")
             .join(texts.select(F.col("_rep").alias("_y"), F.col("_text").alias("_ty")), "_y")
             .select("_x", "_y", "_tx", "_ty"))
    kind = pairs.schema["_x"].dataType.simpleString()
    # A skewed join runs as many small tasks; few of them have links to write.
    width = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sided.mapInArrow(run, f"_x {kind}, _y {kind}").coalesce(width)


def components(links: DataFrame) -> DataFrame:
    """``_rep, _class`` of the nodes of ``_x, _y``: the smallest node each one is connected with.

    Rounds of "take the smallest label among the neighbours, then the label of that label", until no label moves. The
    minimum is summed up before the shuffle, so a hub of any degree is one row per task.
    """
    both = cut(links.select(F.col("_x").alias("_u"), F.col("_y").alias("_v"))
               .union(links.select("_y", "_x")).distinct())
    labels = cut(both.groupBy("_u").agg(F.min(F.least("_u", "_v")).alias("_l")))
    while True:
        near = (both.join(labels.select(F.col("_u").alias("_v"), F.col("_l").alias("_n")), "_v")
                .groupBy("_u").agg(F.min("_n").alias("_n")))
        lower = labels.join(near, "_u").select("_u", "_l", F.least("_l", "_n").alias("_m"))
        jump = lower.select(F.col("_u").alias("_m"), F.col("_m").alias("_j"))
        moved = cut(lower.join(jump, "_m").select("_u", "_l", F.least("_m", "_j").alias("_m")))
        labels = moved.select("_u", F.col("_m").alias("_l"))
        if moved.filter("_l <> _m").isEmpty():
            return labels.select(F.col("_u").alias("_rep"), F.col("_l").alias("_class"))


def classes_of(rows: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Rows with their bags, and the class of each bag, of ``_row, _text`` (``_row`` names the text).

    Returns ``_row, _bag`` (``_bag`` null where a text has no words) and ``_bag, _class``, the number of a connected class.
    """
    bagged = cut(signed(rows))
    worded = bagged.filter("_bag is not null")
    # One row per bag: copies of a text have the same keys. The numbers stand once they are checkpointed.
    named = cut(worded.groupBy("_bag").agg(F.min("_row").alias("_row"), F.max("_size").alias("_size"), F.first("_keys").alias("_keys"))
                .withColumn("_rep", F.monotonically_increasing_id()))
    member = named.select("_rep", "_size", F.explode("_keys").alias("_key"))
    hubs = member.groupBy("_key").agg(F.min("_rep").alias("_hub"), F.count(F.lit(1)).alias("_m")).filter("_m > 1")
    buckets = cut(member.join(hubs.select("_key", "_hub"), "_key"))
    texts = cut(rows.join(named.select("_row", "_rep").join(buckets.select("_rep").distinct(), "_rep"), "_row")
                .select("_rep", "_text").dropDuplicates(["_rep"]))
    weights = named.select(F.col("_rep").alias("_y"), F.col("_size").alias("_other"))
    pairs = buckets.filter("_rep <> _hub").select(F.col("_rep").alias("_x"), "_size", F.col("_hub").alias("_y")).distinct()
    links = cut(verified(pairs.join(weights, "_y").filter(alike("_size", "_other", least)).select("_x", "_y"), texts, least))
    for round_ in range(1, HUBS + 1):
        classes = cut(components(links))
        placed = (buckets.select("_key", "_rep", "_size").join(classes, "_rep", "left")
                  .withColumn("_class", F.coalesce("_class", "_rep")))
        open_ = placed.groupBy("_key").agg(F.min("_class").alias("_lo"), F.max("_class").alias("_hi"), F.count(F.lit(1)).alias("_m")).filter("_lo < _hi")
        placed = cut(placed.join(open_.select("_key", "_m"), "_key"))
        if placed.isEmpty():
            break
        if round_ < HUBS:
            # The member that meets most others stands nearest to the middle of its group, where most links end.
            central = placed.groupBy("_rep").agg(F.sum("_m").alias("_w"))
            hub = placed.join(central, "_rep").groupBy("_key").agg(F.max(F.struct("_w", "_rep", "_class", "_size")).alias("_h"))
            pairs = (placed.join(hub, "_key").filter((F.col("_class") != F.col("_h._class")) & alike("_size", "_h._size", least))
                     .select(F.col("_rep").alias("_x"), F.col("_h._rep").alias("_y")).distinct())
        else:
            pairs = rare_pairs(texts, placed.select("_rep", "_size", "_class").distinct(), least)
        known = classes.filter("_rep <> _class").select(F.col("_rep").alias("_x"), F.col("_class").alias("_y"))
        links = cut(known.union(verified(pairs, texts, least)).distinct())
    else:
        classes = components(links)
    found = named.select("_bag", "_rep").join(classes, "_rep", "left").select("_bag", F.coalesce("_class", "_rep").alias("_class"))
    return bagged.select("_row", "_bag"), found


def row_name(text: str, key: str) -> Column:
    """A row is named by its id and the hashes of its text, so an id with several texts is several names; null ids come last."""
    return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(text).alias("a"),
                    F.xxhash64(F.lit(1), text).alias("b")).alias("_row")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """``key, class_id, n_copies``: one row per document; the class is the smallest id of the texts it is connected with.

    ``n_copies`` counts the rows with the same bag of shingles. Documents without words (null, empty) are classes of their own.
    An id with several texts has a row for each, with the class of that text; it gives its name to one of these classes, and to
    another only where that has no other id. A null id is in the class of its text and names none: a class of null ids only has a null ``class_id``. Repeated rows repeat the result; other columns are not read. An empty table
    gives an empty result.
    """
    prepare(docs.sparkSession)
    rows, classes = classes_of(docs.select(row_name(text, key), F.col(text).alias("_text")), least)
    worded = rows.filter("_bag is not null")
    # An id with several texts names the class of one of them only.
    owned = worded.groupBy(F.col("_row.id").alias("_id")).agg(F.min("_bag").alias("_bag")).groupBy("_bag").agg(F.min("_id").alias("_own"))
    placed = (worded.groupBy("_bag").agg(F.min("_row.id").alias("_id"), F.count(F.lit(1)).alias("_n")).join(owned, "_bag", "left")
              .join(classes, "_bag"))
    placed = cut(placed)
    heads = placed.groupBy("_class").agg(F.coalesce(F.min("_own"), F.min("_id")).alias("_head"))
    named = placed.join(heads, "_class").select("_bag", "_head", "_n")
    worded = worded.join(named, "_bag").select("_row", "_head", "_n")
    alone = rows.filter("_bag is null").select("_row", F.col("_row.id").alias("_head"), F.lit(1).cast("bigint").alias("_n"))
    return worded.union(alone).select(F.col("_row.id").alias(key), F.col("_head").alias("class_id"), F.col("_n").alias("n_copies"))


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """One document of each group stays: the one of the smallest id, null ids last, ties by the hashes of the text.

    Groups are those of ``near_duplicates``, so unrelated texts that share an id do not remove each other. Of rows that agree in
    id and text, one stays. Documents without words all stay.
    """
    prepare(docs.sparkSession)
    rows, classes = classes_of(docs.select(row_name(text, key), F.col(text).alias("_text")), least)
    placed = cut(rows.filter("_bag is not null").groupBy("_bag", "_row").agg(F.count(F.lit(1)).alias("_n")).join(classes, "_bag")
                 .select("_row", "_class", "_n"))
    heads = placed.groupBy("_class").agg(F.min("_row").alias("_head"))
    fate = (placed.join(heads, "_class").filter((F.col("_row") != F.col("_head")) | (F.col("_n") > 1))
            .select("_row", (F.col("_row") == F.col("_head")).alias("_stays")))
    whole = docs.select(F.struct("*").alias("_doc"), row_name(text, key))
    once = whole.join(fate.filter("_stays").select("_row"), "_row").dropDuplicates(["_row"])
    return whole.join(fate.select("_row"), "_row", "left_anti").select("_doc.*").union(once.select("_doc.*"))
