"""Quality rules from distribution divergence, in DataFrame functions only.

Every document gives two histograms: of character classes and of its language's common
words. The reference of a language is the centre of its documents' histograms: their mean,
then means with weights that fall with the distance from the centre before, so that a
share of junk does not draw it away. A document that stands too far from the reference
(Jensen-Shannon distance, 0 to 1) is rejected. Short documents are noisy, so either test
needs a least length.

One pass over the texts writes one small row per document; references and verdicts are
made from these rows.

Defined results: a missing or empty text has no words and fails the base rule; texts of
any length are read whole; a missing or unknown language shares one reference without
common words; repeated rows give repeated results; an empty table gives no rows; other
columns are ignored (`judge`) or kept (`passing`). Windows of five words are compared by
64-bit hashes of the words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legnet.llm.streams import without_ids
from legnet.plans.store import cut

# Common words of each language.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "was", "for", "on", "are", "with", "as", "be"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"),
}
#: Character classes in the order of the histogram; what is left is the last bin.
SPACES = r"\x20\x09-\x0D"
CLASSES = (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", SPACES, r".,;:!?'\"()\-")
N_CLASSES = len(CLASSES) + 1
N_COMMON = 17  # sixteen words and all others
#: Weighted means after the first one; a weight is 1 / (distance + SOFTEN) squared.
REFINES, SOFTEN = 3, 0.02

#: Least length of each test, and the distance it allows: a + b / sqrt(length), since the
#: histogram of n draws lies about 1 / sqrt(n) from its source.
MIN_WORDS, WORD_LIMIT = 50, (0.10, 2.1)
MIN_CHARS, CLASS_LIMIT = 200, (0.155, 1.15)

_SPACE = r"[\x20\x09-\x0D]+"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where use needs it many times."""
    return F.transform(F.array(value), use)[0]


def words_of(body: Column) -> Column:
    return F.filter(F.split(body, _SPACE), lambda w: w != "")


def repeat_words(words: Column, size: int = 5) -> Column:
    """Words covered by windows of `size` words that the array holds twice or more."""

    def window(hs: Column) -> Column:
        return F.transform(
            F.slice(hs, 1, F.size(hs) - (size - 1)),
            lambda h, i: F.xxhash64(h, *[F.get(hs, i + j) for j in range(1, size)]),
        )

    def covered(hashes: Column) -> Column:
        def places(s: Column) -> Column:
            marked = F.transform(
                s,
                lambda e, i: F.when(
                    (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]), e["i"]
                ),
            )
            return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        total = F.aggregate(
            bound(pairs, places),
            zero,
            lambda acc, i: F.struct(
                (acc["n"] + i + size - F.greatest(i, acc["end"])).alias("n"), (i + size).alias("end")
            ),
        )
        return total["n"].cast("long")

    def of_hashes(hs: Column) -> Column:
        return F.when(F.size(F.array_distinct(hs)) < F.size(hs), covered(hs)).otherwise(F.lit(0).cast("long"))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(
        F.size(words) > size, bound(hashed, lambda hs: bound(window(hs), of_hashes))
    ).otherwise(F.lit(0).cast("long"))


def features(docs: DataFrame, id_col: str, text: str, lang: str) -> DataFrame:
    """One small row per document: base counts and both histograms."""
    rows = docs.select(
        docs[id_col].alias("id"),
        F.when(docs[lang].isin(*COMMON), docs[lang]).otherwise(F.lit("")).alias("lang"),
        F.coalesce(docs[text], F.lit("")).alias("body"),
    )
    # Every class is taken out of what the classes before it left.
    rows = rows.select("*", F.col("body").alias("left0"), F.char_length("body").cast("long").alias("chars0"))
    for i, c in enumerate(CLASSES):
        rest = rows.withColumn(f"left{i + 1}", F.regexp_replace(f"left{i}", f"[{c}]+", ""))
        rows = rest.withColumn(f"chars{i + 1}", F.char_length(f"left{i + 1}").cast("long")).drop(f"left{i}")
    last = len(CLASSES)
    taken = [F.col(f"chars{i}") - F.col(f"chars{i + 1}") for i in range(last)]
    rows = rows.select(
        "id", "lang",
        F.array(*taken, F.col(f"chars{last}")).alias("classes"),
        F.col("chars0").alias("n_chars"),
        (F.col("chars0") - taken[CLASSES.index(SPACES)]).alias("word_chars"),
        # No class holds a symbol, so all of them are still there.
        (F.octet_length(f"left{last}") - F.octet_length(F.regexp_replace(f"left{last}", r"[#*$%&|<>]+", "")))
        .cast("long").alias("n_symbols"),
        words_of(F.col("body")).alias("words"),
        F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.filter(F.split("body", r"[^\p{L}]+"), lambda w: w != "").alias("letters"),
    )

    # The common words alone, with two spaces between them, so neighbours do not share one.
    def only(words: tuple[str, ...]) -> Column:
        found = F.filter("letters", lambda w: F.lower(w).isin(*words))
        return F.concat(F.lit(" "), F.lower(F.array_join(found, "  ")), F.lit(" "))

    few = F.lit(None).cast("string")
    for code, words in COMMON.items():
        few = F.when(F.col("lang") == code, only(words)).otherwise(few)
    rows = rows.withColumn("few", few)

    def counted(w: str) -> Column:
        lost = F.octet_length("few") - F.octet_length(F.replace("few", F.lit(f" {w} "), F.lit("")))
        return (lost / (len(w.encode()) + 2)).cast("long")

    common = F.lit(None).cast("array<long>")
    for code, words in COMMON.items():
        common = F.when(F.col("lang") == code, F.array(*[counted(w) for w in words])).otherwise(common)
    return rows.select(
        "id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        "n_chars",
        "classes",
        F.size("letters").cast("long").alias("n_letters"),
        common.alias("common"),
    )


def shares(counts: Column) -> Column:
    """A histogram divided by its sum; NULL where the sum is 0."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(total > 0, bound(total, lambda n: F.transform(counts, lambda x: x / n)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares, base 2."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: (part(x, y) + part(y, x)) / 2)
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(total.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), total)))


def references(rows: DataFrame) -> DataFrame:
    """(of, q_class, q_common): one row per language of COMMON and one for the rest."""

    def centre(given: DataFrame, name: str, n: int) -> Column:
        weight = F.pow(F.col(f"d_{name}") + SOFTEN, F.lit(-2.0))
        total = F.sum(F.when(F.col(f"p_{name}").isNotNull(), weight))
        parts = [F.sum(weight * F.col(f"p_{name}")[i]) / total for i in range(n)]
        return F.when(total > 0, F.array(*parts)).alias(f"q_{name}")

    given = rows.withColumns({"d_class": F.lit(0.0), "d_common": F.lit(0.0)})
    for turn in range(REFINES + 1):
        known = given.groupBy(F.col("lang").alias("of")).agg(
            centre(given, "class", N_CLASSES), centre(given, "common", N_COMMON)
        )
        if turn < REFINES:
            given = rows.join(F.broadcast(known), rows["lang"] == known["of"]).select(
                "lang", "p_class", "p_common",
                distance(F.col("p_class"), F.col("q_class")).alias("d_class"),
                distance(F.col("p_common"), F.col("q_common")).alias("d_common"),
            )
    return known


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    min_words: int = MIN_WORDS,
    word_limit: tuple[float, float] = WORD_LIMIT,
    min_chars: int = MIN_CHARS,
    class_limit: tuple[float, float] = CLASS_LIMIT,
) -> DataFrame:
    """id, base counts, both distances (NULL where too short), base_failed and kept."""
    rows = cut(features(docs, id_col, text, lang))
    long_enough = (F.col("n_words") >= min_words) & F.col("common").isNotNull()
    others = F.concat("common", F.array(F.col("n_letters") - F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)))
    rows = rows.withColumns(
        {
            "p_class": F.when(F.col("word_chars") >= min_chars, shares(F.col("classes"))),
            "p_common": F.when(long_enough, shares(others)),
        }
    )

    rows = rows.join(F.broadcast(references(rows)), rows["lang"] == F.col("of"), "left")
    rows = rows.withColumns(
        {
            "class_distance": distance(F.col("p_class"), F.col("q_class")),
            "word_distance": distance(F.col("p_common"), F.col("q_common")),
            "base_failed": (F.col("n_words") < 10)
            | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    )

    def allowed(limit: tuple[float, float], length: str) -> Column:
        return limit[0] + limit[1] / F.sqrt(F.greatest(F.col(length), F.lit(1)).cast("double"))

    far = (F.coalesce("class_distance", F.lit(0.0)) > allowed(class_limit, "word_chars")) | (
        F.coalesce("word_distance", F.lit(0.0)) > allowed(word_limit, "n_words")
    )
    return rows.select(
        F.col("id").alias(id_col),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "class_distance", "word_distance", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"),
    )


def passing(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that are kept, with all columns.

    The verdict is joined by the id: rows that share one stay together if one of them
    is kept, and rows without an id stay.
    """
    verdicts = judge(docs, id_col, text, lang).groupBy(id_col).agg(F.max("kept").alias("kept"))
    return without_ids(docs, id_col, verdicts.where(~F.col("kept")).select(id_col))
