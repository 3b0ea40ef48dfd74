"""Operator 1: sharding by histogram sort.

The sort key is (key column, hash of the whole row, row number). The row number is only
needed, and only stored, where a splitter falls among rows that are equal in every
column. Bytes below candidate
boundaries ("probes") are counted exactly over all partitions, the bracket around
every wanted splitter is divided again, and this repeats until each splitter is
within the tolerance. Only then do the rows move, once, into key-ordered buckets.
Probes, splitters and counts on the driver are bounded by ``cells`` and the number
of buckets, never by the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

LOW, HIGH = -(2**63), 2**63 - 1


@dataclass
class Bracket:
    """Keys ``lo..hi`` (inclusive), the bytes below ``lo``, and the byte targets that fall inside."""

    lo: int
    hi: int
    below: int
    targets: list[int]
    prefix: int | None = None


def _search(sorted_cols: list, value):
    """How many entries of a sorted literal array are <= value, by bisection."""
    n = len(sorted_cols)
    if not n:
        return F.lit(0)
    arr = F.array(*sorted_cols)
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(n.bit_length()))])
    return F.aggregate(
        steps, F.lit(0),
        lambda pos, step: F.when(
            (pos + step <= n) & (F.element_at(arr, F.least(pos + step, F.lit(n))) <= value), pos + step
        ).otherwise(pos),
    )


def _refine(narrow: DataFrame, col: str, brackets: list[Bracket], cells: int, slack: int) -> tuple[dict, list]:
    """Divides brackets until every target has a boundary.

    Returns {target: boundary} and the (value, target, bytes below value) where one
    single value of ``col`` with several rows holds the target.
    """
    done: dict[int, int] = {}
    single: list[tuple[int, int, int]] = []
    while brackets:
        brackets.sort(key=lambda b: (b.prefix or 0, b.lo))
        prefix = F.lit(0).cast("long") if brackets[0].prefix is None else F.col("__key")
        entry = [F.struct(F.lit(b.prefix or 0).cast("long").alias("k"), F.lit(b.lo).cast("long").alias("v")) for b in brackets]
        at = _search(entry, F.struct(prefix.alias("k"), F.col(col).alias("v"))) - 1
        rows = narrow.select(at.alias("b"), F.col(col).alias("v"), "__size", prefix.alias("k")).where("b >= 0")
        if brackets[0].prefix is not None:
            rows = rows.where(F.element_at(F.array(*[F.lit(b.prefix).cast("long") for b in brackets]), F.col("b") + 1) == F.col("k"))
        per = max(2, cells // len(brackets))
        widths = [max(1, -(-(b.hi - b.lo + 1) // per)) for b in brackets]
        pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("decimal(20,0)") for v in values]), F.col("b") + 1)
        off = F.col("v").cast("decimal(20,0)") - pick([b.lo for b in brackets])
        rows = rows.where((off >= 0) & (F.col("v") <= pick([b.hi for b in brackets])))
        cell = F.floor(off / pick(widths)).cast("long")
        found = rows.groupBy("b", cell.alias("c")).agg(F.sum("__size").alias("s"), F.count("*").alias("n")).collect()
        seen: dict[int, list] = {}
        for r in found:
            seen.setdefault(r["b"], []).append((r["c"], r["s"], r["n"]))
        following: list[Bracket] = []
        for i, b in enumerate(brackets):
            below, left = b.below, sorted(b.targets)
            for c, s, n in sorted(seen.get(i, [])):
                inside = []
                while left and left[0] <= below + s:
                    inside.append(left.pop(0))
                lo = b.lo + c * widths[i]
                hi = min(b.hi, lo + widths[i] - 1)
                again = []
                for t in inside:
                    if t <= below + 0:
                        done[t] = lo
                    elif below + s - t <= slack:
                        done[t] = hi + 1
                    elif lo == hi and n == 1:
                        done[t] = hi + 1
                    elif lo == hi:
                        single.append((lo, t, below))
                    else:
                        again.append(t)
                if again:
                    following.append(Bracket(lo, hi, below, again, b.prefix))
                below += s
        brackets = following
    return done, single


def find_splitters(narrow: DataFrame, parts: int, numbered, tolerance: float = 0.0, cells: int = 4096) -> tuple[list[tuple[int, int, int]], DataFrame | None]:
    """The ``parts - 1`` splitters (key, hash, row): part i starts at the first row whose
    preceding bytes reach i/parts of the total, exactly for tolerance 0, else at most
    ``tolerance`` of a part's bytes later.

    ``numbered`` stores the rows of the given (key, hash) pairs with a ``__row`` and is only
    called where a splitter falls among equal rows; its table is given back.
    """
    t = narrow.agg(F.sum("__size").alias("s"), F.min("__key").alias("lo"), F.max("__key").alias("hi")).first()
    if t["s"] is None:
        return [], None
    total = t["s"]
    wanted = [-(-i * total // parts) for i in range(1, parts)]
    slack = int(tolerance * total / parts)
    done, single = _refine(narrow, "__key", [Bracket(t["lo"], t["hi"], 0, sorted(set(wanted)))], cells, slack)
    cut = {k: (v, LOW, LOW) if v <= HIGH else (HIGH, HIGH, HIGH) for k, v in done.items()}
    hot = None
    if single:
        grouped: dict[int, Bracket] = {}
        for value, target, below in single:
            grouped.setdefault(value, Bracket(LOW, HIGH, below, [], value)).targets.append(target)
        inner = narrow.where(F.col("__key").isin(list(grouped)))
        owner = {x: v for v, b in grouped.items() for x in b.targets}
        done, single = _refine(inner, "__hash", list(grouped.values()), cells, slack)
        cut |= {k: (owner[k], v, LOW) if v <= HIGH else (owner[k], HIGH, HIGH) for k, v in done.items()}
        if single:
            equal: dict[tuple[int, int], Bracket] = {}
            for value, target, below in single:
                pair = (owner[target], value)
                equal.setdefault(pair, Bracket(0, HIGH, below, [], len(equal))).targets.append(target)
            hot = numbered(list(equal))
            pairs = {x: pair for pair, b in equal.items() for x in b.targets}
            inner = hot.select(_which(list(equal)).alias("__key"), "__row", "__size")
            done, _ = _refine(inner, "__row", list(equal.values()), cells, slack)
            cut |= {k: (*pairs[k], min(v, HIGH)) for k, v in done.items()}
    return [cut[w] for w in wanted], hot


def _which(pairs: list[tuple[int, int]]):
    """The number of a row's (key, hash) among ``pairs``, NULL for none."""
    out = F.lit(None).cast("long")
    for i, (k, h) in enumerate(pairs):
        out = F.when((F.col("__key") == k) & (F.col("__hash") == h), F.lit(i).cast("long")).otherwise(out)
    return out


def histogram_shards(
    df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", tolerance: float = 0.0,
    cells: int = 4096, buckets_per_shard: int | None = None,
) -> DataFrame:
    """All rows with ``shard`` (0..shards-1), ``slot`` (gapless in a shard, in key order) and ``size``.

    Size is the UTF-8 length of ``text`` plus 1; a NULL text counts 1. Shards are ranges
    of the order (key, row hash); shard i starts at the first row with at least
    i/shards of all bytes before it, so shards differ by less than one row from equal
    bytes (plus the tolerance). A NULL key sorts first. A key that holds many rows is
    cut inside by the row hash, and rows equal in every column are cut by their number.
    An empty table gives an empty result. Further columns pass through;
    existing columns named shard, slot or size are replaced.
    """
    spark = df.sparkSession
    base = df.drop("shard", "slot", "size")
    hashed = [f.name for f in base.schema if not isinstance(f.dataType, T.MapType)]
    full = base.select(
        "*",
        F.coalesce(F.col(key).cast("long"), F.lit(LOW)).alias("__key"),
        F.xxhash64(*[F.col(f"`{c}`") for c in hashed]).alias("__hash"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("__size"),
    )
    narrow = materialize(full.select("__key", "__hash", "__size"), "shard-keys")
    if buckets_per_shard is None:
        buckets_per_shard = max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    parts = shards * buckets_per_shard

    def numbered(pairs: list) -> DataFrame:
        return materialize(full.where(_which(pairs).isNotNull()).withColumn("__row", F.monotonically_increasing_id()), "shard-equal")

    cuts, hot = find_splitters(narrow, parts, numbered, tolerance, cells)
    full, narrow = full.withColumn("__row", F.lit(0).cast("long")), narrow.withColumn("__row", F.lit(0).cast("long"))
    if hot is not None:
        pairs = [tuple(r) for r in hot.select("__key", "__hash").distinct().collect()]  # at most one a splitter
        other = _which(pairs).isNull()
        full = full.where(other).unionByName(hot)
        narrow = narrow.where(other).unionByName(hot.select(*narrow.columns))
    entry = [F.struct(*[F.lit(x).cast("long").alias(n) for x, n in zip(c, "khr", strict=True)]) for c in cuts]
    bucket = _search(entry, F.struct(F.col("__key").alias("k"), F.col("__hash").alias("h"), F.col("__row").alias("r")))
    counts = {r["b"]: r["n"] for r in narrow.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()}
    offsets = []
    for b in range(parts):
        offsets.append(0 if b % buckets_per_shard == 0 else offsets[-1] + counts.get(b - 1, 0))
    order = Window.partitionBy("__bucket").orderBy("__key", "__hash", "__row")
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("__bucket") + 1)
    return (
        full.withColumn("__bucket", bucket).repartitionById(parts, F.col("__bucket"))
        .withColumn("slot", F.row_number().over(order) - 1 + start)
        .withColumn("shard", F.floor(F.col("__bucket") / buckets_per_shard).cast("int"))
        .withColumn("size", F.col("__size"))
        .drop("__key", "__hash", "__size", "__row", "__bucket")
    )
