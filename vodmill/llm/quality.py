"""Operator 4: line-first quality rules, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD_GAP, split_words

#: A line passes the punctuation rule if it ends in one of these (quotes or brackets may follow)
#: or holds the end of a sentence inside, as a long line cut off at its end does.
TERMINAL = (".", "!", "?", "…", ":", ";", "。", "！", "？", "।", "॥", "؟", "۔", "።", "။", "។")
CLOSING = "\"'”’»)]"
#: Phrases of site furniture in English, German, French and Spanish, in lower case.
#: A line of at most FURNITURE_WORDS words that holds one as whole words goes.
BOILERPLATE = (
    "javascript", "cookie", "cookies", "lorem ipsum", "all rights reserved", "terms of use", "terms of service",
    "privacy policy", "sign in", "log in", "subscribe", "share this", "read more", "copyright",
    "impressum", "datenschutz", "datenschutzerklärung", "alle rechte vorbehalten", "nutzungsbedingungen", "startseite", "anmelden", "abonnieren", "weiterlesen", "mehr lesen",
    "mentions légales", "tous droits réservés", "témoins de connexion", "politique de confidentialité", "conditions d'utilisation", "se connecter", "s'abonner", "lire la suite",
    "aviso legal", "todos los derechos reservados", "política de privacidad", "términos de uso", "condiciones de uso", "iniciar sesión", "suscríbete", "leer más",
)
FURNITURE_WORDS = 20
#: A navigation line has at most so many words, in three labels or more, of one word and a half on average at most, and so many characters.
LABEL_WORDS = 12
LABEL_CHARS = 120
LABEL_ENDS = ".!?|›»·•/:"
#: A line of at most LABEL_WORDS words that stands so often in a text is furniture of its page.
REPEATED = 3
SYMBOLS = "#*$%&|<>"


def count_repeat_words(df: DataFrame, words: str, out: str, few: int = 16) -> DataFrame:
    """Adds ``out``: words inside 3-word windows that occur at least twice, each position once.

    Windows are compared by a 64-bit hash. Sorted (hash, position) pairs put equal
    windows side by side, so a text of n words takes n log n steps and no shuffle;
    texts without a repeated window skip the sort.
    """
    n = F.size(words)
    w = F.col(words)
    df = df.withColumn(
        "__win",
        F.transform(
            F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
        ),
    )
    df = df.withColumn("__sorted", F.when(F.size("__win") > F.size(F.array_distinct("__win")), F.sort_array("__win")))
    o = F.col("__sorted")
    df = df.withColumn("__twice", F.array_distinct(F.filter(o, lambda h, i: F.coalesce(F.get(o, i - 1) == h, F.lit(False)))))
    twice = F.col("__twice")
    # few repeated windows: look each one up; many: sort pairs, so that no text takes quadratic time
    found = F.filter(
        F.transform("__win", lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull()
    )
    pairs = F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    df = df.withColumn("__pairs", F.when(F.size(twice) > few, pairs))
    p = F.col("__pairs")
    same = lambda x, j: F.coalesce(F.get(p, j)["h"] == x["h"], F.lit(False))
    sorted_at = F.sort_array(F.transform(F.filter(p, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))
    at = F.when(twice.isNull(), None).when(F.size(twice) > few, sorted_at).otherwise(found)
    df = df.withColumn("__at", at)
    a = F.col("__at")
    covered = F.aggregate(
        F.transform(a, lambda x, i: F.least(F.coalesce(F.get(a, i + 1) - x, F.lit(3)), F.lit(3))),
        F.lit(0).cast("long"), lambda s, x: s + x,
    )
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop("__win", "__sorted", "__twice", "__pairs", "__at")


def _has(text: Column, parts) -> Column:
    found = F.lit(False)
    for x in parts:
        found = found | F.contains(text, F.lit(x))
    return found


def line_ok(line: Column, furniture: bool, repeated: Column, symbol_share: float = 0.2, shout_share: float = 0.3) -> Column:
    """The per-line rules: punctuation, navigation, symbols, shouting, boilerplate, repeated short lines.

    Navigation: a short line of at least three labels, each ended by a sentence end, bar, dot
    or arrow, with one word and a half each on average at most. ``furniture``: whether to look for boilerplate
    phrases, needed only where the whole text holds one. ``repeated``: the text's short lines
    that stand often. The costly tests run only on lines that are short or hold a symbol or ``!!``.
    """
    words = F.size(F.array_remove(F.split(line, WORD_GAP), ""))
    marked = F.when(_has(line, SYMBOLS), F.regexp_count(line, F.lit(r"[#*$%&|<>]+")) > symbol_share * words)
    shouted = F.when(F.contains(line, F.lit("!!")), F.regexp_count(line, F.lit("!!")) > shout_share * words)
    ends = F.length(line) - F.length(F.translate(line, LABEL_ENDS, ""))
    labels = F.regexp_count(line, F.lit(r"[.!?|›»·•/:]+(?=[\s\"'”’»)\]]|$)"))
    menu = F.when((F.length(line) <= LABEL_CHARS) & (ends >= 3), (words <= LABEL_WORDS) & (labels >= 3) & (2 * words <= 3 * labels))
    phrase = F.lit(False)
    if furniture:
        named = "|".join(BOILERPLATE).replace(" ", r"\s+")
        phrase = F.when((words <= FURNITURE_WORDS) & _has(F.lower(line), BOILERPLATE), F.lower(line).rlike(rf"(?<!\p{{L}})(?:{named})(?!\p{{L}})"))
    often = F.when(F.size(repeated) > 0, F.array_contains(repeated, line))
    end = F.substring(F.rtrim(line, F.lit(SPACES + CLOSING)), -1, 1)
    no = F.lit(False)
    return (
        (end.isin(*TERMINAL) | _has(line, (". ", "! ", "? ")))
        & ~F.coalesce(marked, no) & ~F.coalesce(shouted, no) & ~F.coalesce(menu, no) & ~F.coalesce(phrase, no) & ~F.coalesce(often, no)
    )


def sorted_short(lines: Column) -> Column:
    """The short lines among ``lines``, sorted, so that equal ones stand side by side."""
    return F.sort_array(F.filter(lines, lambda s: (F.length(s) <= LABEL_CHARS) & (F.size(F.array_remove(F.split(s, WORD_GAP), "")) <= LABEL_WORDS)))


def clean_lines(
    df: DataFrame, text: str = "text", min_kept: float = 0.5, min_words: int = 50,
) -> DataFrame:
    """Adds the measures, ``clean_text`` (failing lines removed) and ``kept``.

    ``base_failed``: fewer than ``min_words`` words or more than half of the words in
    repeated 3-word windows. ``kept``: not base_failed and at least ``min_kept`` of the
    word characters stand in lines that pass. Lines without a word stay and count
    nothing. A NULL text has no words, so it fails; an empty table stays empty.
    Columns of the input pass through, except that columns named like the results are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    blank = lambda s: F.btrim(s, F.lit(SPACES)) == ""
    out = df.withColumn("__w", split_words(F.col(text))).withColumn("n_words", F.size("__w").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
    out = count_repeat_words(out, "__w", "n_repeat_words").drop("__w")
    out = out.withColumn("__split", F.split(t, "\n")).withColumn("__lines", F.filter("__split", lambda s: ~blank(s)))
    symbols = F.when(_has(t, SYMBOLS), F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).otherwise(0)
    out = out.withColumns({
        "n_symbols": symbols.cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    })
    out = out.withColumn("__short", F.when(F.col("n_dup_lines") >= REPEATED - 1, sorted_short(F.col("__lines"))))
    sorted_ = F.col("__short")
    often = F.array_distinct(F.filter(sorted_, lambda s, i: F.coalesce(F.get(sorted_, i - (REPEATED - 1)) == s, F.lit(False))))
    out = out.withColumn("__often", often)
    searched = F.filter("__split", lambda s: blank(s) | line_ok(s, True, F.col("__often")))
    plain = F.filter("__split", lambda s: blank(s) | line_ok(s, False, F.col("__often")))
    out = out.withColumn("__low", F.lower(t))
    out = out.withColumn("__named", _has(F.col("__low"), BOILERPLATE)).drop("__low")
    out = out.withColumn("__good", F.when(F.col("__named"), searched).otherwise(plain)).drop("__named")
    out = out.withColumn("clean_text", F.when(F.col(text).isNotNull(), F.array_join("__good", "\n")))
    out = out.withColumn("kept_chars", F.length(F.array_join(split_words(F.col("clean_text")), "")).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        out.withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("kept_chars") >= F.lit(min_kept) * F.col("word_chars")))
        .drop("__split", "__lines", "__short", "__often", "__good")
    )


def keep_clean(df: DataFrame, text: str = "text", min_kept: float = 0.5, min_words: int = 50) -> DataFrame:
    """The rows of ``clean_lines`` that are kept.

    The row number only keeps the optimizer from moving the test below the measures,
    where it would put every nested expression of ``kept`` in place of each of its uses.
    """
    rows = clean_lines(df, text, min_kept, min_words).withColumn("__row", F.monotonically_increasing_id())
    return rows.where(F.col("kept") & (F.col("__row") >= 0)).drop("__row")
