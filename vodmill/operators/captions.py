"""Captions against candidates: interval joins, quote alignment, support scores, audit and grounding."""

from __future__ import annotations

import difflib
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType, StringType

from vodmill.functions import candidates as C

from .blocks import following
from .bloom import passing

#: Tolerance of the audit in seconds, the least support of a claim, window limits of the grounding.
TOLERANCE, SUPPORT, WINDOW_SEGMENTS, WINDOW_SECONDS = 5, 0.68, 12, 30
BUCKET = 300
SENTINEL = "no verified in window transcript evidence"
#: Units that are spelled out after a number.
UNITS = {"v": "volts", "ma": "milliamps"}
_WORD, _GAP = r"\p{L}\p{N}_", r"[\s\x1c-\x1f\x85\p{Z}]"
_UNIT = "\x01"  # stands before a unit while a text is cut


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def tokens(text: Column | str) -> Column:
    """Words of letters a-z and digits, with an apostrophe part; '1,200' is one number, units after a number are spelled out.

    ASCII texts stay in built-in functions; only others go to Python to be folded. A NULL
    text has no words.
    """
    raw = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    plain = ~raw.rlike(r"[^\x00-\x7F]")
    low = F.translate(F.when(plain, F.lower(raw)).otherwise(_folded(F.when(~plain, raw))), _UNIT + "’", "-'")
    numbers = F.regexp_replace(low, r"(?<=\p{Nd}),(?=\p{Nd})", "")
    marked = F.regexp_replace(numbers, rf"(?<![{_WORD}])(\p{{Nd}}+){_GAP}*({'|'.join(UNITS)})(?![{_WORD}])", f"$1 {_UNIT}$2")

    def spelled(word: Column) -> Column:
        out = word
        for unit, name in UNITS.items():
            out = F.when(word.rlike(f"^{_UNIT}{unit}(?:'|$)"), F.concat(F.lit(name), F.regexp_extract(word, "'.*$", 0))).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(marked, F.lit(f"{_UNIT}?[a-z0-9]+(?:'[a-z]+)?"), F.lit(0)), spelled)


def with_chunks(df: DataFrame, text: str) -> DataFrame:
    """A row per claim chunk of ``text`` (``chunk``: its tokens, ``chunk_no``); texts without a chunk keep one row with NULL."""
    sentences = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[.!?;\n]+"), lambda s: F.trim(s) != "")
    rows = df.withColumn("__s", sentences).select("*", F.posexplode_outer("__s").alias("__i", "__t")).withColumn("__tok", tokens(F.coalesce("__t", F.lit(""))))
    rows = rows.select("*", F.posexplode_outer(C.claim_chunks(F.col("__tok"))).alias("__j", "chunk"))
    return rows.withColumn("chunk_no", F.struct(F.coalesce("__i", F.lit(0)).alias("i"), F.coalesce("__j", F.lit(0)).alias("j"))).drop("__s", "__i", "__t", "__tok", "__j")


def _windows(claim: list[str], context: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, shared): windows of ``width`` words or up to the end that hold a word of the claim, and how many they share with it.

    The places of each claim word in the context are listed once; running counts of them
    give what any window holds, each word as often as the claim has it at most.
    """
    places: dict[str, list[int]] = {w: [] for w in claim}
    for i, w in enumerate(context):
        if w in places:
            places[w].append(i)
    n = len(context)
    ends = np.minimum(np.arange(n) + width, n)
    shared = np.zeros(n, np.int64)
    for w, need in Counter(claim).items():
        if places[w]:
            count = np.zeros(n + 1, np.int64)
            count[np.array(places[w]) + 1] = 1
            count = np.cumsum(count)
            shared += np.minimum(count[ends] - count[:n], need)
    starts = np.flatnonzero(shared)
    return starts, shared[starts]


def _common(places: dict[str, int], n: int, window: list[str]) -> int:
    """Length of the longest common subsequence; ``places`` has a bit per place of each of the claim's ``n`` words."""
    row = full = (1 << n) - 1
    for w in window:
        if hit := row & places.get(w, 0):
            row = (row + hit | row - hit) & full
    return n - row.bit_count()


def score_support(claim: list[str], context: list[str]) -> float:
    """Q2: 1.0 if the claim's words stand in the context in a row; else the best of
    0.65 x matching ratio + 0.35 x shared words over windows of two widths.

    Only windows that hold a word of the claim count. Those that could score highest by their shared
    words are measured first; the rest is settled once no bound beats the best. Matching blocks stand in
    order, so they hold no more words than the longest common subsequence: a window that it bounds is not measured.
    """
    n = len(claim)
    if not n or not context:
        return 0.0
    if " ".join(claim) in " ".join(context):
        return 1.0
    found = []
    for width in (n, n + max(3, min(12, n // 2))):
        starts, shared = _windows(claim, context, width)
        size = np.minimum(width, len(context) - starts)
        bound = 0.65 * 2 * shared / (n + size) + 0.35 * shared / n
        found += zip(bound.tolist(), starts.tolist(), size.tolist(), shared.tolist(), strict=True)
    best = 0.0
    places: dict[str, int] = {}
    for i, w in enumerate(claim):
        places[w] = places.get(w, 0) | 1 << i
    for bound, start, size, shared in sorted(found, key=lambda x: -x[0]):
        if bound <= best:
            break
        most = 2.0 * _common(places, n, context[start:start + size]) / (n + size)
        if 0.65 * most + 0.35 * shared / n <= best:
            continue
        ratio = difflib.SequenceMatcher(None, claim, context[start:start + size], autojunk=False).ratio()
        best = max(best, 0.65 * ratio + 0.35 * shared / n)
    return best


@F.pandas_udf(DoubleType())
def _measured(claims: pd.Series, contexts: pd.Series) -> pd.Series:
    return pd.Series([0.0 if c is None or x is None else score_support(list(c), list(x)) for c, x in zip(claims, contexts, strict=True)])


def support_score(claim: Column | str, context: Column | str) -> Column:
    """Q2 for columns of words: claims that stand in the context, or share no word with it, are settled
    by built-in functions; only the others go to Python. NULL or empty words give 0."""
    c, x = (F.col(v) if isinstance(v, str) else v for v in (claim, context))
    exact = F.contains(F.array_join(x, " "), F.array_join(c, " "))
    open_ = F.coalesce(~exact & F.arrays_overlap(c, x), F.lit(False))
    none = (F.coalesce(F.size(c), F.lit(0)) <= 0) | (F.coalesce(F.size(x), F.lit(0)) <= 0)
    measured = _measured(F.when(open_, c), F.when(open_, x))
    return F.when(none, 0.0).when(exact, 1.0).when(open_, measured).otherwise(0.0)


def _level(length: Column, width: int) -> Column:
    """0 for lengths up to ``width``, then one more for each doubling."""
    return F.greatest(F.ceil(F.log2(F.greatest(length, F.lit(1)) / width)), F.lit(0)).cast("int")


def bucketed(segments: DataFrame, start: str, end: str, width: int = BUCKET * 1000) -> DataFrame:
    """Segments with (__lv, __b): buckets as wide as the segment is long, rounded up to a doubling of ``width``; two rows a segment at most."""
    level = _level(F.col(end) - F.col(start), width)
    rows = segments.withColumn("__lv", level).withColumn("__w", F.lit(width) * F.pow(F.lit(2), F.col("__lv")).cast("long"))
    return rows.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / F.col("__w")), F.floor(F.col(end) / F.col("__w"))))).drop("__w")


def interval_join(cands: DataFrame, segments: DataFrame, before: int = 0, after: int = 0, starts_only: bool = False) -> DataFrame:
    """Candidate rows with the segments of their stream that overlap [start - before, end + after] seconds.

    With ``starts_only`` a segment must start inside. Both sides are keyed by (stream,
    level, time bucket): buckets of a level are as wide as its segments are long, so a segment
    is two keys at most, and a long stream many; each pair comes out once. Candidates look into the levels that occur.
    """
    lo, hi = F.greatest(F.col("start_seconds") - before, F.lit(0)) * 1000, (F.greatest("start_seconds", "end_seconds") + after) * 1000
    width = BUCKET * 1000
    s = bucketed(segments.withColumn("__e", F.col("start_ms") if starts_only else F.greatest("start_ms", "end_ms")), "start_ms", "__e", width)
    # a level for each doubling of a segment's length that occurs: some twenty at most
    levels = [0] if starts_only else sorted(r["l"] for r in segments.select(_level(F.greatest("start_ms", "end_ms") - F.col("start_ms"), width).alias("l")).distinct().collect()) or [0]
    a = cands.withColumn("__lo", lo).withColumn("__hi", hi).withColumn("__lv", F.explode(F.array(*[F.lit(v) for v in levels])))
    w = F.lit(width) * F.pow(F.lit(2), F.col("__lv")).cast("long")
    a = a.withColumn("__w", w).withColumn("__b", F.explode(F.sequence(F.floor(F.col("__lo") / F.col("__w")), F.floor(F.col("__hi") / F.col("__w")))))
    first = F.greatest(F.floor(F.col("__lo") / F.col("__w")), F.floor(F.col("start_ms") / F.col("__w")))
    inside = F.col("start_ms").between(F.col("__lo"), F.col("__hi")) if starts_only else (F.col("start_ms") <= F.col("__hi")) & (F.col("__e") >= F.col("__lo"))
    return a.join(s, ["stream_id", "__lv", "__b"]).where(inside & (F.col("__b") == first)).drop("__b", "__lv", "__w", "__lo", "__hi", "__e")


def normalized_words(c: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), "")


def caption_words(segments: DataFrame, text: str = "text", order: tuple[str, ...] = ("start_ms",), ms: str = "start_ms") -> DataFrame:
    """(stream_id, place, second, word): the words of each stream in caption order; place is (order, word number)."""
    w = segments.select("stream_id", F.struct(*order).alias("o"), F.floor(F.col(ms) / 1000).alias("second"), F.posexplode(normalized_words(F.col(text))).alias("k", "word"))
    return w.select("stream_id", F.struct("o", "k").alias("place"), "second", "word")


def word_ngrams(words: DataFrame, n: int = 8) -> DataFrame:
    """Every word with the words that follow it, up to n in all; a stream of any length is many blocks."""
    return following(words, "stream_id", ["place"], ["word"], n, "gram")


def caption_grams(segments: DataFrame, n: int = 8, text: str = "text", order: tuple[str, ...] = ("start_ms",), ms: str = "start_ms") -> DataFrame:
    """``word_ngrams`` of ``caption_words``: (stream_id, place, second, gram), with a text's words left together.

    Grams inside a segment are cut where it is read. Only its first and last n - 1 words are put
    in order, for the grams that go on in the segments behind it.
    """
    own = normalized_words(F.col(text))
    rows = segments.select("stream_id", F.struct(*order).alias("o"), F.floor(F.col(ms) / 1000).alias("second"), own.alias("w")).where(F.size("w") > 0)
    late = F.greatest(F.size("w") - (n - 1), F.lit(0))
    inner = rows.where(F.size("w") >= n).select("stream_id", "o", "second", "w", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("k"))
    inner = inner.select("stream_id", F.struct("o", "k").alias("place"), "second", F.slice("w", F.col("k") + 1, F.lit(n)).alias("gram"))
    if n == 1:
        return inner
    edges = rows.select("stream_id", "o", "second", late.alias("at"), F.array_join(F.slice("w", 1, n - 1), " ").alias("head"), F.array_join(F.slice("w", late + 1, F.lit(n - 1)), " ").alias("tail"))
    # a segment has a word at least, so n of them hold every gram
    edges = following(edges, "stream_id", ["o"], ["head"], n, "heads")
    own_words = F.split("tail", " ")
    whole = F.concat(own_words, F.split(F.array_join(F.slice("heads", F.lit(2), F.lit(n)), " "), " "))
    edges = edges.withColumn("w", F.when(F.size("heads") > 1, whole).otherwise(own_words)).withColumn("k", F.explode(F.sequence(F.lit(0), F.size(own_words) - 1)))
    outer = edges.select("stream_id", F.struct("o", (F.col("at") + F.col("k")).alias("k")).alias("place"), "second", F.slice("w", F.col("k") + 1, F.lit(n)).alias("gram"))
    return inner.unionByName(outer)


def _prefix_key(words: Column | str) -> Column:
    return F.xxhash64("stream_id", words)


def quote_prefixes(needles: DataFrame, words: DataFrame, long: int, short: int) -> DataFrame:
    """(stream_id, key, k, gram, place, second): the places of the captions whose first k words may begin a needle.

    ``words`` are rows of words, or of grams. Only lengths k that needles have are taken, and a Bloom filter of the needles' keys drops
    nearly all other places before anything is exchanged.
    """
    lengths = [r["k"] for r in needles.select("k").distinct().collect()]
    names = {f"__{k}": k for k in sorted(lengths) or [1]}
    grams = words if "gram" in words.columns else word_ngrams(words, long)
    keyed = [F.when(F.size("gram") >= k, _prefix_key(F.slice("gram", 1, k))).alias(n) for n, k in names.items()]
    rows = passing(grams.select("stream_id", "gram", "place", "second", *keyed), list(names), needles.select("key"))
    found = F.explode(F.filter(F.array(*[F.struct(F.lit(k).cast("int").alias("k"), F.col(n).alias("key")) for n, k in names.items()]), lambda x: x["key"].isNotNull()))
    return rows.withColumn("x", found).select("stream_id", "x.key", "x.k", "gram", "place", "second")


def align_quotes(quotes: DataFrame, words: DataFrame, long: int = 8, short: int = 5) -> DataFrame:
    """``second`` of the first place where the quote's first min(n, 8) words stand; quotes of more words fall back to 5.

    ``quotes`` has quote_id, stream_id, quote; ``words`` are rows of ``caption_words``, or of ``caption_grams`` of ``long`` words. A hash of the stream and of the first words, a power of two of them up to ``short``,
    keys the join; the whole needle is compared in it. Equal places of a stream, and equal needles, meet once. NULL where nothing matches.
    """
    q = quotes.select("quote_id", "stream_id", normalized_words(F.col("quote")).alias("w")).where(F.size("w") > 0)
    cut = lambda k: F.array_join(F.slice("w", 1, k), " ")
    needles = q.select("quote_id", "stream_id", "w", F.explode(F.when(F.size("w") > long, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("rank"))
    needles = needles.withColumn("n", F.least(F.size("w"), F.when(F.col("rank") == 0, long).otherwise(short)))
    # keys of one, two, four, ... words: few lengths to look up at each place
    needles = needles.withColumn("k", F.pow(F.lit(2), F.floor(F.log2(F.least("n", F.lit(short))))).cast("int"))
    keyed = needles.select("stream_id", "n", "k", _prefix_key(F.slice("w", F.lit(1), F.col("k"))).alias("key"), F.when(F.col("rank") == 0, cut(long)).otherwise(cut(short)).alias("need"))
    asked = needles.select("quote_id", "stream_id", "rank", F.when(F.col("rank") == 0, cut(long)).otherwise(cut(short)).alias("need"))
    places = quote_prefixes(keyed, words, long, short)
    first = places.groupBy("stream_id", "key", "k", F.array_join("gram", " ", "\x00").alias("gram")).agg(F.min(F.struct("place", "second")).alias("p"))
    hit = keyed.distinct().join(first, ["stream_id", "key", "k"]).where(F.call_function("substring_index", F.col("gram"), F.lit(" "), F.col("n")) == F.col("need"))
    found = hit.groupBy("stream_id", "need").agg(F.min("p").alias("p"))
    best = asked.join(found, ["stream_id", "need"]).groupBy("quote_id", "stream_id").agg(F.min(F.struct("rank", "p"))["p"]["second"].alias("second"))
    return quotes.join(best, ["quote_id", "stream_id"], "left")


def quote_verdict(start: Column, end: Column, second: Column) -> tuple[Column, Column]:
    """(new start, note) of a quote found at ``second``."""
    moved = second.between(start - 15, start - 1)
    note = F.when(second.isNull(), "").when(second.between(start, end), "caption_quote_verified").when(moved, "start_adjusted_to_caption_quote").otherwise("caption_quote_outside_window")
    return F.when(moved, second).otherwise(start), note


def contexts(cands: DataFrame, segments: DataFrame, key: str = "candidate_window_id") -> DataFrame:
    """(key, context): words of the captions around each candidate, in time order."""
    pairs = interval_join(cands.select(key, "stream_id", "start_seconds", "end_seconds"), segments, TOLERANCE, TOLERANCE)
    rows = pairs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start_ms", "text"))).alias("s"))
    return rows.select(key, tokens(F.array_join(F.transform("s", lambda x: x["text"]), " ")).alias("context"))


def audit_evidence(cands: DataFrame, segments: DataFrame, require_timed: bool = False, key: str = "candidate_window_id") -> DataFrame:
    """Q3 (and, with ``require_timed``, Q4): status pass, fail or unverifiable, and issues.

    ``cands`` has transcript_excerpt and transcript_evidence. Streams without captions are
    unverifiable (Q4: pass). Every chunk of given evidence must reach the least support.
    Without evidence an empty or sentinel excerpt passes, one without chunks is
    unverifiable, all chunks supported pass, none unverifiable, some fail; under Q4 any
    other excerpt fails for want of evidence.
    """
    captioned = segments.select("stream_id").distinct().withColumn("has", F.lit(True))
    base = cands.join(captioned, "stream_id", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    timed = F.size(F.coalesce("transcript_evidence", F.array().cast("array<struct<timestamp:string,seconds:bigint,text:string>>"))) > 0
    plain = F.array_join(tokens(F.coalesce("transcript_excerpt", F.lit(""))), " ")
    base = base.withColumn("timed", timed).withColumn("plain", plain)
    claim = F.when(F.col("timed"), F.array_join(F.transform("transcript_evidence", lambda e: e["text"]), ".\n")).otherwise(F.col("transcript_excerpt"))
    rows = with_chunks(base.where("has").select(key, claim.alias("claim")), "claim").where("chunk IS NOT NULL")
    scored = rows.join(contexts(cands, segments, key), key, "left").withColumn("score", support_score("chunk", F.coalesce("context", F.array().cast("array<string>"))))
    per = scored.groupBy(key).agg(F.count("*").alias("chunks"), F.count_if(F.col("score") >= SUPPORT).alias("supported"))
    out = base.join(per, key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(0))).withColumn("supported", F.coalesce("supported", F.lit(0)))
    quiet = (F.col("plain") == "") | F.startswith("plain", F.lit(SENTINEL))
    legacy = F.when(quiet, "pass")
    if require_timed:
        legacy = legacy.otherwise("fail")
    else:
        legacy = legacy.when(F.col("chunks") == 0, "unverifiable").when(F.col("supported") == F.col("chunks"), "pass").when(F.col("supported") == 0, "unverifiable").otherwise("fail")
    status = F.when(~F.col("has"), "pass" if require_timed else "unverifiable").when(F.col("timed"), F.when(F.col("supported") == F.col("chunks"), "pass").otherwise("fail")).otherwise(legacy)
    issue = F.when(F.col("chunks") > F.col("supported"), F.concat((F.col("chunks") - F.col("supported")).cast("string"), F.lit(" of "), F.col("chunks").cast("string"), F.lit(" claims lack support")))
    return out.select(key, "stream_id", status.alias("status"), "chunks", "supported", F.array_compact(F.array(issue)).alias("issues"))


def evidence_windows(segments: DataFrame) -> DataFrame:
    """For every segment the runs of up to 12 consecutive segments that start within 30 s of it."""
    held = following(segments.select("stream_id", "event", "start_ms", "text", F.col("start_ms").alias("at")), "stream_id", ["event", "start_ms"], ["at", "text"], WINDOW_SEGMENTS, "__next")
    rows = held.withColumn("__run", F.filter("__next", lambda s: s["at"] <= F.col("start_ms") + WINDOW_SECONDS * 1000))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("__run")), lambda n: F.struct(n.alias("length"), F.array_join(F.transform(F.slice("__run", F.lit(1), n), lambda s: s["text"]), " ").alias("text")))
    return rows.select("stream_id", "event", "start_ms", F.explode(prefixes).alias("p")).select("stream_id", "event", "start_ms", "p.length", F.col("p.text").alias("text"))


def ground_evidence(cands: DataFrame, segments: DataFrame, key: str = "candidate_window_id") -> DataFrame:
    """Q5: evidence for excerpts that have none: each chunk's best window; all chunks must reach the least support.

    Higher score wins, then the shorter text, then the earlier place. (key, grounded, evidence).
    """
    need = cands.where((F.size("transcript_evidence") == 0) & (F.trim(F.coalesce("transcript_excerpt", F.lit(""))) != ""))
    chunks = with_chunks(need.select(key, "transcript_excerpt"), "transcript_excerpt").where("chunk IS NOT NULL").select(key, "chunk_no", "chunk")
    inside = interval_join(need.select(key, "stream_id", "start_seconds", "end_seconds"), segments, starts_only=True)
    # windows are built per candidate, from segments inside it only
    windows = evidence_windows(inside.select(F.col(key).alias("stream_id"), "event", "start_ms", "text")).withColumnRenamed("stream_id", key)
    windows = windows.withColumn("tok", tokens("text"))
    # a window can only ground a chunk if its words let the score reach the least support; others take no part
    held = F.size(F.filter("chunk", lambda w: F.array_contains("tok", w)))
    size = F.size("chunk")
    reach = 1.3 * held / (size + held) + 0.35 * held / size
    pairs = chunks.join(windows, key).where(reach >= SUPPORT - 1e-9).withColumn("score", support_score("chunk", "tok"))
    best = pairs.groupBy(key, "chunk_no").agg(F.max_by(F.struct("score", "start_ms", "text"), F.struct("score", -F.length("text"), -F.col("event"), -F.col("length"))).alias("b"))
    all_ = chunks.select(key, "chunk_no").join(best, [key, "chunk_no"], "left").groupBy(key).agg(
        F.min(F.coalesce("b.score", F.lit(0.0))).alias("least"),
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "b"))), lambda x: F.struct(F.floor(x["b"]["start_ms"] / 1000).alias("seconds"), x["b"]["text"].alias("text")))).alias("evidence"))
    return all_.select(key, (F.col("least") >= SUPPORT).alias("grounded"), F.when(F.col("least") >= SUPPORT, F.col("evidence")).alias("evidence"))
