"""Quality rules: line-first cleaning (DataFrame functions only).

Every line is tried against punctuation, navigation and boilerplate rules; failing lines
are removed; a document that loses more than ``max_lost`` of its word characters is
rejected, as is one that fails the base rules (too few words, too many repeated ones).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, let

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST = 0.5
#: A line with fewer characters must end like a sentence.
SHORT_LINE = 40
# Patterns that Java's and RE2's regular expressions read alike.
WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
SENTENCE_END = r"""[.!?\x22'):;\x{2026}\x{201D}\x{00BB}]$"""
SHOUTED = r"!!|\?\?"
NAV_MARK = r"[|\x{00BB}\x{203A}\x{2022}]"
#: Stock phrases in lower case, by language; every line is tried against all of them.
PHRASES = {
    "en": ("rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "enable javascript", "click here", "subscribe to our", "skip to content"),
    "de": ("alle rechte vorbehalten", "datenschutzerklärung", "allgemeine geschäftsbedingungen", "cookie-richtlinie", "javascript aktivieren", "klicken sie hier", "zum inhalt springen"),
    "fr": ("tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "activer javascript", "cliquez ici", "aller au contenu"),
    "es": ("todos los derechos reservados", "política de privacidad", "términos de uso", "aviso legal", "política de cookies", "haga clic aquí", "ir al contenido"),
    "": ("lorem ipsum",),
}
BOILERPLATE = tuple(p for ps in PHRASES.values() for p in ps)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_BREAK), "")


def _stripped(line: Column) -> Column:
    return F.trim(line, F.lit(WS_CHARS))


def _any(text: Column, phrases) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(text, F.lit(p))
    return found


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more, each counted once.

    Windows are sorted by a prefix of their hash, with their positions; where two windows of
    one prefix differ, or positions need more bits, the words themselves are sorted instead.
    """
    bits = 20
    prefix = lambda x: F.shiftright(x, bits)
    position = lambda x: x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def grams(ws: Column) -> Column:
        n, pair = F.size(ws), lambda a, b: F.xxhash64(a, b)
        return F.slice(F.zip_with(F.zip_with(ws, F.slice(ws, 2, n), pair), F.slice(ws, 3, n), pair), 1, n - 2)

    def repeated(ws: Column, gs: Column) -> Column:
        # Longs sort several times faster than structs.
        packed = F.sort_array(F.transform(gs, lambda g, i: F.shiftleft(F.shiftright(g, bits), bits).bitwiseOR(i.cast("long"))))
        window = lambda i: F.struct(F.get(ws, i).alias("a"), F.get(ws, i + 1).alias("b"), F.get(ws, i + 2).alias("c"))
        whole = F.sort_array(F.transform(gs, lambda g, i: F.struct(window(i).alias("w"), i.alias("i"))))
        exact = let(whole, lambda s: _covered(s, lambda x: x["w"], lambda x: x["i"]))

        def by_prefix(s: Column) -> Column:
            unlike = lambda x, y: window(position(x)) != window(position(y))
            clash = F.exists(
                F.sequence(F.lit(1), F.size(s) - 1),
                lambda k: (prefix(F.get(s, k)) == prefix(F.get(s, k - 1))) & unlike(F.get(s, k), F.get(s, k - 1)),
            )
            return F.when(clash, exact).otherwise(_covered(s, prefix, position))

        alone = F.size(F.array_distinct(gs)) == F.size(gs)
        return F.when(alone, 0).when(F.size(gs) < (1 << bits), let(packed, by_prefix)).otherwise(exact)

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(words, lambda ws: let(grams(ws), lambda gs: repeated(ws, gs))))


def _covered(ordered: Column, key, position) -> Column:
    """Words in windows whose key an array neighbour shares."""
    twice = F.filter(
        ordered,
        lambda x, k: F.coalesce(key(F.get(ordered, k - 1)) == key(x), F.lit(False)) | F.coalesce(key(F.get(ordered, k + 1)) == key(x), F.lit(False)),
    )
    return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(position(x), position(x) + 1, position(x) + 2)))))


def bad_line(raw: Column, symbols: Column, shouts: Column, marks: Column, stocked: Column, phrases: Sequence[str] = BOILERPLATE) -> Column:
    """True if a line with a word breaks a rule.

    The next arguments say whether the whole text has a symbol, shout, mark or phrase at
    all; where it has none, its lines need not be searched for one.
    """

    def breaks(line: Column) -> Column:
        n_words = F.size(F.filter(F.split(line, WORD_BREAK), lambda w: w != ""))
        few = (F.length(line) < SHORT_LINE) & ~line.rlike(SENTENCE_END)
        noisy = symbols & (F.regexp_count(line, F.lit(SYMBOLS)) * 10 > F.length(line))
        loud = shouts & (F.regexp_count(line, F.lit(SHOUTED)) * 4 > n_words)
        menu = marks & (F.regexp_count(line, F.lit(NAV_MARK)) * 3 > n_words)
        stock = stocked & let(F.lower(line), lambda low: _any(low, phrases))
        return few | noisy | loud | menu | stock

    return let(_stripped(raw), breaks)


def clean_lines(
    docs: DataFrame,
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_lost: float = MAX_LOST,
    phrases: Sequence[str] = BOILERPLATE,
) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``clean_text``, ``lost_chars`` and ``kept``.

    ``phrases`` are the stock phrases, in lower case, of the languages that are expected.

    A null text counts as an empty one: no words, base failed, not kept.  Each input row,
    repeated ones too, gives one output row.  Input columns whose names clash with the new
    ones are replaced.  Work is per row; nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumns({"__w": words_of(text), "__l": F.filter(F.split(text, "\n"), lambda x: _stripped(x) != "")})
    d = d.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("__w")).cast("long"),
        "__shouts": _any(text, ("!!", "??")),
        "__marks": _any(text, ("|", "»", "›", "•")),
        "__phrases": let(F.lower(text), lambda low: _any(low, phrases)),
    })
    has = F.col("n_symbols") > 0, F.col("__shouts"), F.col("__marks"), F.col("__phrases")
    d = d.withColumn("__bad", F.filter("__l", lambda x: bad_line(x, *has, phrases)))
    d = d.withColumns({
        "clean_text": F.when(F.size("__bad") == 0, F.array_join("__l", "\n")).otherwise(
            F.array_join(F.filter("__l", lambda x: ~bad_line(x, *has, phrases)), "\n")
        ),
        "base_failed": (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent),
        "lost_chars": F.length(F.array_join(words_of(F.array_join("__bad", "\n")), "")).cast("long"),
    })
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= F.col("word_chars") * max_lost))
    return d.drop("__w", "__l", "__bad", "__shouts", "__marks", "__phrases")


def quality_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return clean_lines(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"
    )


_Q = lambda s: "'" + s.replace("'", "''") + "'"
_WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_STOCK = " or ".join(f"contains(lower(x), {_Q(p)})" for p in BOILERPLATE)

QUALITY_SQL = rf"""
with d as (select doc_id, coalesce(text, '') t, row_number() over () rid from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
g as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] gram
      from (select rid, ws, unnest(range(1, len(ws) - 1)) i from w where len(ws) >= 3)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, gram) n from g) where n > 1),
cov as (select rid, count(distinct i + k) n from rep, (values (0), (1), (2)) o(k) group by rid),
c as (select w.rid, doc_id, len(ws)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
      coalesce(cov.n, 0)::bigint n_repeat_words, ls from w left join cov using (rid)),
ln as (select rid, x raw, trim(x, {_WS}) x from (select rid, unnest(ls) x from c)),
lf as (select rid, raw, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) nw from ln),
bad as (select rid, sum(length(regexp_replace(raw, '[\x20\x09-\x0D]', '', 'g')))::bigint n from lf
       where (length(x) < {SHORT_LINE} and not regexp_matches(x, {_Q(SENTENCE_END)}))
         or len(regexp_extract_all(x, {_Q(SYMBOLS)})) * 10 > length(x)
         or len(regexp_extract_all(x, {_Q(SHOUTED)})) * 4 > nw or len(regexp_extract_all(x, {_Q(NAV_MARK)})) * 3 > nw
         or {_STOCK} group by rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) base_failed,
  (not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
   and coalesce(bad.n, 0) <= word_chars * {MAX_LOST}) kept, coalesce(bad.n, 0)::bigint lost_chars
from c left join bad using (rid)
"""
