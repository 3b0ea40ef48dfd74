"""Operator 10: exact n-gram Jaccard join by parity sketches.

A document's shingle hashes are XORed into cells, each 64 parity bits wide. One shingle
more or less changes one cell, so the number of differing cells is at most the symmetric
difference of two sets. Linked sets of a size band differ in at most d shingles and so
share at least p - d of p cells: documents are joined on equal (band, cell, value). As
p - d is more than one, each document leaves its p - d - 1 most frequent cells out of
the join and still meets every partner, which keeps passages that many documents hold
from making blocks. Sketches of single parity bits then bound the symmetric difference
from below pair by pair, and the sets of the pairs left are compared exactly.

Groups of near copies are not paired out. Each document is first compared with the
leaders of its blocks, the members that share most cells; components follow. Small
blocks that still hold several components compare their pairs. Large ones are cut by the
finest cells, one a shingle: sets of two narrow size classes that link share one of
their rarest shingles, so members of a group that differ from each other in shingles of
their own meet nowhere. So the components are exact, while the pairs compared stay few.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, salted_left_join, short_batches
from .components import components

U = np.uint64
WORDS_REMEMBERED = 100_000
LANES = 16  # of 64 parity bits each
SMALL_BLOCK = 16  # members up to which a block compares its pairs directly
CLASS_BITS = 8  # leading bits of a size that name its narrow class: below 256 each size is one


class Shingler:
    """Distinct n-word shingles of a text as sorted 64-bit hashes. Only A-Z are lower-cased."""

    def __init__(self, n: int):
        import xxhash

        self.n, self.hash, self.memory = n, xxhash.xxh3_64_intdigest, {}

    def shingles(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, U)
        memory = self.memory
        if len(memory) > WORDS_REMEMBERED:
            memory.clear()
        for w in set(words).difference(memory):
            memory[w] = self.hash(w)
        h = np.fromiter(map(memory.__getitem__, words), dtype=U, count=len(words))
        size = min(self.n, len(words))
        out = np.full(len(words) - size + 1, size, dtype=U)
        for i in range(size):
            out = (out ^ h[i:len(h) - size + 1 + i]) * U(0x9E3779B97F4A7C15)
            out ^= out >> U(29)
        out *= U(0xBF58476D1CE4E5B9)
        out ^= out >> U(32)
        return np.unique(out)


def bands(up_to: int, percent: int) -> list[int]:
    """Lower ends of the size bands: a set links only into its own band and the next or the one before."""
    ends = [1]
    while ends[-1] <= up_to:
        ends.append(max(ends[-1] + 1, (ends[-1] - 1) * 100 // percent + 1))
    return ends


def most_different(a: int, b: int, percent: int) -> int:
    """The largest symmetric difference of linked sets of sizes a and b."""
    return (a + b) * (100 - percent) // (100 + percent)


def cells_of(band: int, ends: list[int], percent: int) -> tuple[int, int]:
    """(most differing cells, cells) for pairs whose smaller set lies in ``band``; (0, 0): none can link."""
    top = ends[band + 1] - 1
    d = most_different(top, top * 100 // percent, percent)
    return d, 0 if not d else d + 1 + max(d // 8, 3 if d >= 40 else 2 if d >= 10 else 1 if d >= 2 else 0)


def cell_keys(s: np.ndarray, band: int, d: int, p: int) -> tuple[np.ndarray, int]:
    """(keys of the cells of one sketch of the sorted hashes ``s``, how many of the most frequent may be left out).

    Empty cells carry nothing to tell texts apart. Linked sets share at least p - d equal
    cells, so they share p - d less the empty ones of either at least that are filled.
    Only a set with p - d empty cells or more gives the empty ones out too, and all of them.
    """
    edges = -(-(np.arange(p + 1, dtype=np.int64) << 32) // p)
    at = np.searchsorted((s >> U(32)).astype(np.int64), edges)
    total = np.concatenate([np.zeros(1, U), np.bitwise_xor.accumulate(s)])
    value = total[at[1:]] ^ total[at[:-1]]
    filled = at[1:] > at[:-1]
    where = np.arange(p, dtype=U) + (U(band) << U(32))
    key = (value ^ (where * U(0x94D049BB133111EB))) * U(0x9E3779B97F4A7C15)
    key ^= key >> U(31)
    key = (key + where) * U(0xBF58476D1CE4E5B9)
    key ^= key >> U(29)
    shared = int(filled.sum()) - d
    return (key[filled], shared - 1) if shared > 0 else (key, 0)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _fingerprint(s: np.ndarray) -> int:
    import xxhash

    return int(np.array([xxhash.xxh3_64_intdigest(s.tobytes())], dtype=U).view(np.int64)[0])


def _map(df: DataFrame, n: int, make, schema: str) -> DataFrame:
    """Runs ``make(shingler, ids, texts, seen)`` over Arrow batches; seen lives as long as the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(n), set()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield make(shingler, part.column(0), part.column(1), seen)

    short_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def _keys(percent: int):
    """Size and fingerprint of every row's set, and the cell keys of its two bands for the first of the copies in a task."""

    def make(shingler, ids, texts, seen):
        ends = bands(1, percent)
        ns, fps, drops, keys = [], [], ([], []), ([], [])
        for t in texts:
            s = shingler.shingles(t.as_py())
            mark = (len(s), _fingerprint(s) if len(s) else 0)
            ns.append(mark[0])
            fps.append(mark[1])
            found = [None, None]
            if len(s) and mark not in seen:
                seen.add(mark)
                if len(ends) < 2 or len(s) >= ends[-2]:
                    ends = bands(2 * len(s), percent)
                j = int(np.searchsorted(ends, len(s), side="right")) - 1
                found = [cell_keys(s, b, *dp) if b >= 0 and (dp := cells_of(b, ends, percent))[1] else None for b in (j - 1, j)]
            for k, f in enumerate(found):
                drops[k].append(f[1] if f else None)
                keys[k].append(_signed(f[0]) if f else None)
        return pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(fps, pa.int64()), pa.array(drops[0], pa.int64()), pa.array(keys[0], pa.list_(pa.int64())),
             pa.array(drops[1], pa.int64()), pa.array(keys[1], pa.list_(pa.int64()))],
            names=["id", "n", "fp", "drop0", "keys0", "drop1", "keys1"])

    return make


def set_marks(text, n: int):
    """Column struct<n, fp>: size and hash of a text's shingle set, as ``jaccard_components(marks=True)`` has them."""
    @F.pandas_udf("n long, fp long")
    def marks(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(n)
        for part in texts:
            sets = [shingler.shingles(t) for t in part]
            yield pd.DataFrame({"n": [len(s) for s in sets], "fp": [_fingerprint(s) if len(s) else 0 for s in sets]})

    return marks(text)


def parity(s: np.ndarray, bits: int) -> np.ndarray:
    """Parity sketch of ``bits`` (a power of two, 64 or more) bits; half the length is its two halves XORed."""
    odd = np.flatnonzero(np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1)
    out = np.zeros(bits // 64, dtype=U)
    np.bitwise_or.at(out, odd >> 6, U(1) << (odd & 63).astype(U))
    return out


def _sets(shingler, ids, texts, seen):
    sets = [shingler.shingles(t.as_py()) for t in texts]
    lanes, wide = np.zeros((len(sets), LANES), dtype=U), []
    for i, s in enumerate(sets):
        lanes[i] = parity(s, LANES * 64)
        wide.append(_signed(parity(s, 1 << (len(s) - 1).bit_length())) if len(s) > LANES * 64 else np.empty(0, np.int64))
    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_fingerprint(s) if len(s) else 0 for s in sets], pa.int64()),
         pa.array([_signed(s) for s in sets], pa.list_(pa.int64())),
         pa.array(wide, pa.list_(pa.int64())), *[pa.array(_signed(np.ascontiguousarray(lanes[:, k])), pa.int64()) for k in range(LANES)]],
        names=["id", "n", "fp", "shingles", "wide", *[f"s{k}" for k in range(LANES)]])


def _within(percent: int, x: str, y: str, lanes: int = LANES):
    """Whether the sketches of columns x*, y* allow a link: sizes and Hamming distance of the parity bits."""
    total = F.col(f"{x}n") + F.col(f"{y}n")
    far = sum(F.bit_count(F.col(f"{x}s{k}").bitwiseXOR(F.col(f"{y}s{k}"))) for k in range(lanes))
    near = F.floor(total * (100 - percent) / F.lit(100 + percent))
    return (100 * F.least(f"{x}n", f"{y}n") >= percent * F.greatest(f"{x}n", f"{y}n")) & (far <= near), far


def _prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(p + c) for c in df.columns])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link.

    Long texts are told apart first by sketches about as many bits long as their sets
    are large, so that few of their sets have to move.
    """
    w = sets.select("id", "n", "wide")
    far = pairs.join(_prefixed(w, "a"), F.col("a") == F.col("aid")).join(_prefixed(w, "b"), F.col("b") == F.col("bid"))
    x, y = F.col("awide"), F.col("bwide")

    def fold(v):
        half = (F.size(v) / 2).cast("int")
        return F.zip_with(F.slice(v, F.lit(1), half), F.slice(v, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    def distance(p, q):
        return F.aggregate(F.zip_with(p, q, lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda t, i: t + i)

    low = F.when(F.size(x) == F.size(y), distance(x, y)).when(F.size(x) == 2 * F.size(y), distance(fold(x), y)).when(
        2 * F.size(x) == F.size(y), distance(x, fold(y))).otherwise(0)
    pairs = far.where(low <= F.floor((F.col("an") + F.col("bn")) * (100 - percent) / F.lit(100 + percent))).select("a", "b")
    s = sets.select("id", "n", "shingles")
    both = pairs.join(_prefixed(s, "a"), F.col("a") == F.col("aid")).drop("aid").join(_prefixed(s, "b"), F.col("b") == F.col("bid"))
    inter = F.size(F.array_intersect("ashingles", "bshingles"))
    return both.where(100 * inter >= percent * (F.col("an") + F.col("bn") - inter)).select("a", "b")


def _blocks(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, id, lead, size): the members of every block of cells that at least two texts share."""
    rows = None
    for band in (0, 1):
        part = keyed.select("fp", F.expr(f"shiftleft(n, 24) + 2 * drop{band} + {band}").alias("meta"), F.explode(f"keys{band}").alias("key"))
        rows = part if rows is None else rows.unionByName(part)
    block = Window.partitionBy("key")
    shared = rows.withColumn("lo", F.min("fp").over(block)).withColumn("hi", F.max("fp").over(block)).withColumn("size", F.count("*").over(block))
    shared = materialize(shared.where("lo != hi").select("key", "fp", "meta", "size").dropDuplicates(["key", "fp", "meta"]), "blocks")

    shared = shared.select("key", "fp", F.expr("shiftright(meta, 24)").alias("n"), F.expr("meta & 1").alias("band"), F.expr("shiftright(meta & 16777215, 1)").alias("drop"), "size")
    text, hottest = Window.partitionBy("fp", "n"), Window.partitionBy("fp", "n", "band").orderBy(F.desc("size"), "key")
    kept = shared.repartition("fp", "n").withColumn("rank", F.row_number().over(hottest)).where("rank > drop").withColumn("degree", F.count("*").over(text))
    kept = kept.join(classes.select("fp", "n", "id"), ["fp", "n"]).select("key", "id", "degree")
    heads = kept.groupBy("key").agg(F.count("*").alias("size"), F.max_by("id", F.struct("degree", -F.col("id"))).alias("lead")).where("size > 1")
    return materialize(kept.join(heads, "key").select("key", "id", "lead", "size"), "members")


def _refined(hot: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components c among the documents of ``hot`` that share one of their rarest shingles.

    A size keeps its leading bits as its class. For each class of partners the overlap of
    a linked pair is bounded from below, and with it the number of rarest shingles of
    which at least one is common (prefix principle).
    """
    def floor(x: str) -> str:
        return f"({x} - {x} % shiftleft(1L, greatest(length(bin({x})) - {CLASS_BITS}, 0)))"

    el = hot.join(sets.select("id", "n", "shingles"), "id").select("id", "c", "n", F.explode("shingles").alias("s"))
    common = el.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("id")
    ranked = el.join(common, "s").withColumn("place", F.row_number().over(own.orderBy("df", "s")) + F.col("n") - F.count("*").over(own))
    least, most = f"cast(ceil(n * {percent}D / 100) as bigint)", f"cast(n * 100 div {percent} as bigint)"
    step = f"shiftleft(1L, greatest(length(bin({least})) - {CLASS_BITS}, 0))"
    partners = f"array_distinct(transform(sequence({floor(least)}, {most}, {step}), x -> {floor('x')}))"
    # of n shingles the first n - overlap + 1 suffice, and the least overlap with a set of m or more is percent (n + m) / (100 + percent)
    near = f"filter({partners}, m -> place <= n + 1 - (({percent} * (n + m) + {99 + percent}) div {100 + percent}))"
    # few shingles stand within the longest prefix, that of the smallest partners: the rest need no list of partners
    ranked = ranked.where(F.expr(f"place <= n + 1 - (({percent} * (n + {floor(least)}) + {99 + percent}) div {100 + percent})"))
    keyed = ranked.select("s", "id", "c", F.expr(floor("n")).alias("q"), F.explode(F.expr(near)).alias("m"))
    keyed = materialize(keyed.withColumn("lo", F.least("q", "m")).withColumn("hi", F.greatest("q", "m")), "refined")
    open_ = keyed.groupBy("s", "lo", "hi").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").drop("c1")
    left = keyed.join(open_, ["s", "lo", "hi"])
    x, y = _prefixed(left.where("c != c0"), "a"), _prefixed(left, "b")
    return x.join(y, (F.col("as") == F.col("bs")) & (F.col("aq") == F.col("bm")) & (F.col("am") == F.col("bq")) & (F.col("bc") < F.col("ac"))).select(
        F.col("aid").alias("a"), F.col("bid").alias("b")).distinct()


def _classes(narrow: DataFrame) -> tuple[DataFrame, bool]:
    """(fp, n, rep, id) a distinct set: its least document and a number of its own; whether those two differ anywhere."""
    classes = narrow.where("n > 0").groupBy("fp", "n").agg(F.min("id").alias("rep"))
    plain = not narrow.groupBy("id").agg(F.count("*").alias("c")).where("c > 1 OR id IS NULL").limit(1).count()
    if plain:
        return classes.withColumn("id", F.col("rep")), True
    # an id that stands for several texts numbers the first; the others are numbered by their hashes
    turn = F.row_number().over(Window.partitionBy("rep").orderBy("fp", "n"))
    return materialize(classes.withColumn("id", F.when((turn == 1) & F.col("rep").isNotNull(), F.col("rep")).otherwise(F.xxhash64("fp", "n", "rep"))), "classes"), False


def jaccard_components(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85, small: int = 2_000_000, marks: bool = False,
) -> DataFrame:
    """(doc, n_shingles, component_id) for every row.

    Texts link when 100 x intersection >= percent x union of their distinct n-word
    shingle sets (a shorter text is one shingle). Equal sets are one class from the
    start and stand for all their copies. A text that is NULL, empty or only white
    space has no shingle and links with nothing. component_id is the smallest id
    reachable. Repeated rows come out each; an id with several texts keeps the links of
    each; a NULL id gets the smallest id it reaches, or NULL. Other columns are not
    carried; an empty table gives an empty result. ``marks`` adds the set's hash ``fp``
    (see ``set_marks``) and ``root``, a number of the component (NULL without a shingle).
    ``small``: up to so many candidate ids are broadcast to fetch their texts; beyond it
    they are joined by shuffle.
    """
    src = docs.select(F.col(doc).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    keyed = materialize(_map(src, n, _keys(percent), "id long, n long, fp long, drop0 long, keys0 array<long>, drop1 long, keys1 array<long>"), "keys")
    narrow = materialize(keyed.select("id", "n", "fp"), "sets")
    classes, plain = _classes(narrow)
    members = _blocks(keyed, classes)
    discard(keyed)

    wanted = members.select("id").distinct()
    reps = wanted if plain else classes.join(wanted, "id").select(F.col("rep").alias("id")).distinct()
    source = src.join(F.broadcast(reps), "id", "left_semi") if reps.count() <= small else src.join(reps, "id", "left_semi")
    if not plain:
        source = src.join(reps, src["id"].eqNullSafe(reps["id"]), "left_semi")
    found = _map(source, n, _sets, "id long, n long, fp long, shingles array<long>, wide array<long>, " + ", ".join(f"s{k} long" for k in range(LANES)))
    if not plain:
        found = found.drop("id").join(classes.select("fp", "n", "id").join(wanted, "id"), ["fp", "n"]).dropDuplicates(["id"])
    sets = materialize(found.drop("fp"), "candidates")
    sketches = sets.drop("shingles", "wide")

    # 1. every document against the leaders of its blocks
    pairs = members.where("lead != id").select("lead", "id").distinct()
    ok, _ = _within(percent, "a", "b")
    pairs = (
        pairs.join(_prefixed(sketches, "a"), F.col("lead") == F.col("aid")).join(_prefixed(sketches, "b"), F.col("id") == F.col("bid"))
        .where(ok).select(F.col("aid").alias("a"), F.col("bid").alias("b"))
    )
    links = materialize(_verify(pairs, sets, percent), "links")
    comps = components(links, "a", "b")

    # 2. pairs of different components that share a block
    placed = members.join(comps.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").drop("c1")
    placed = materialize(placed.join(mixed, "key"), "open")
    # block rows carry sketches folded to a quarter; the pairs they leave meet the whole ones
    quarter = LANES // 4
    folded = sketches.select("id", "n", *[reduce(lambda x, y: x.bitwiseXOR(y), [F.col(f"s{k + quarter * i}") for i in range(4)]).alias(f"s{k}") for k in range(quarter)])
    few = placed.where(F.col("size") <= SMALL_BLOCK).join(folded, "id")
    left, right = _prefixed(few.where("c != c0").drop("c0"), "a"), _prefixed(few.drop("c0"), "b")
    ok, _ = _within(percent, "a", "b", quarter)
    more = left.join(right, (F.col("akey") == F.col("bkey")) & (F.col("bc") < F.col("ac")) & ok).select(F.col("aid").alias("a"), F.col("bid").alias("b"))
    more = more.unionByName(_refined(placed.where(F.col("size") > SMALL_BLOCK).select("id", "c").distinct(), sets, percent)).distinct()
    ok, _ = _within(percent, "x", "y")
    more = (
        more.join(_prefixed(sketches, "x"), F.col("a") == F.col("xid")).join(_prefixed(sketches, "y"), F.col("b") == F.col("yid"))
        .where(ok).select("a", "b")
    )
    links = materialize(links.unionByName(_verify(more, sets, percent)), "links")
    comps = components(links, "a", "b").withColumnRenamed("node", "id")

    named = classes.join(comps, "id", "left").select("fp", "n", "rep", F.coalesce("component", "id").alias("component_id"))
    named = named.withColumn("root", F.col("component_id"))
    if not plain:
        least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = named.drop("component_id").join(least, "root")
    named = named.select("fp", "n", "root", "component_id")
    named = named.withColumnRenamed("n", "n_shingles")
    out = salted_left_join(narrow.withColumnRenamed("n", "n_shingles"), named, ["fp", "n_shingles"], "id")
    return out.select(F.col("id").alias(doc), "n_shingles", F.coalesce("component_id", "id").alias("component_id"), *(["fp", "root"] if marks else []))
