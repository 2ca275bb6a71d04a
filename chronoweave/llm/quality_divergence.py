"""Quality rules by distribution divergence, in DataFrame expressions only.

A document's histogram of character classes and its histogram of common words are compared with those of its language
by the Jensen-Shannon distance (base 2, so 0 to 1). The references are sums over all documents of the language that
pass the base rules. A document is rejected if either distance is over its limit; the word limit is wider for short
documents, whose histograms are noisy, and documents under the minimum length are left to the base rules.

Inside a row, repeated three-word windows are found without a shuffle: the windows' hashes are packed with their places
into longs and sorted, and equal neighbours are the repeats. Their words are compared too, and a text in which hashes
clash has its windows sorted as texts, so the count is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm._common import checkpoint, prepare, written

# Common function words of each language, and the marks that stand between items where there is no prose.
MARKS = ["|", "-", "*", "•"]
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split() + MARKS,
    "en": "the of and to a in is that it for was on with as be by this are at from he or an not".split() + MARKS,
    "es": "de la que el en y los se las del con un por no una su para es al lo como más o pero".split() + MARKS,
    "fr": "de la le et les des en un du une que est pour qui par dans sur pas au avec il ce plus ne".split() + MARKS,
}
#: Character classes, taken out of the text one after the other; what is left over is the last class.
CLASSES = (r"\p{Ll}+", r"\p{Lu}+", r"[\x20\x09-\x0D]+", r"[#*$%&|<>]+", r"\p{Nd}+", r"\p{P}+")
SPACE = r"[\x20\x09-\x0D]+"
CLASS_LIMIT, WORD_LIMIT, WORD_SLACK, LEAST_WORDS = 0.30, 0.28, 0.60, 50


#: Tells windows of words apart, nearly always.
WINDOW_HASH = F.xxhash64


def let(value: Column, body) -> Column:
    """body(value) with value computed once: as a variable, it isn't copied into every use."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more."""
    at, nothing = F.get, F.lit(0).cast("long")

    def covered(starts: Column) -> Column:
        step = F.transform(starts, lambda x, i: F.coalesce(F.least(F.lit(3), at(starts, i + 1) - x), F.lit(3)))
        return F.aggregate(step, nothing, lambda a, x: a + x)

    def by_text() -> Column:
        """Windows as texts, sorted with their places: exact in itself, and slow."""

        def starts(s: Column) -> Column:
            def same(x: Column, i: Column) -> Column:
                return F.coalesce(at(s, i)["w"] == x["w"], F.lit(False))

            return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

        texts = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, F.lit(3))).alias("w"), i.alias("i")))
        return let(F.sort_array(texts), lambda s: let(starts(s), covered))

    def by_hash(hashes: Column) -> Column:
        """Hashes cut to make room for places, sorted with them. Equal neighbours must be equal in their words too, or else texts are sorted."""
        bits = F.length(F.bin(F.size(hashes).cast("long"))).cast("int")

        def found(shift: Column) -> Column:
            def judged(s: Column) -> Column:
                mask = F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1
                place = lambda x: x.bitwiseAND(mask).cast("int")

                def same(x: Column, i: Column) -> Column:
                    return F.coalesce(F.call_function("shiftright", at(s, i), shift) == F.call_function("shiftright", x, shift), F.lit(False))

                def differ(x: Column, y: Column) -> Column:
                    return (at(words, x) != at(words, y)) | (at(words, x + 1) != at(words, y + 1)) | (at(words, x + 2) != at(words, y + 2))

                kept = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
                clash = F.size(F.filter(s, lambda x, i: same(x, i - 1) & differ(place(x), place(at(s, i - 1))))) > 0
                return F.when(clash, by_text()).otherwise(let(F.sort_array(F.transform(kept, place)), covered))

            return let(F.sort_array(F.transform(hashes, lambda h, i: F.call_function("shiftleft", h, shift).bitwiseOR(i.cast("long")))), judged)

        # most texts have no window twice
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), nothing).otherwise(let(bits, found))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: WINDOW_HASH(at(words, i), at(words, i + 1), at(words, i + 2)))
    return F.when(F.size(words) < 3, nothing).otherwise(let(windows, by_hash))


def features(text: Column, lang: Column) -> Column:
    """All counts of a text in one struct: the contract's, the class histogram, and the common-word histogram of each language to compare with."""
    none = F.coalesce(text, F.lit(""))

    def classes(t: Column) -> Column:
        def step(i: int, rest: Column) -> Column:
            if i == len(CLASSES):
                return F.array(F.char_length(rest))
            return F.concat(F.array(F.char_length(rest)), let(F.regexp_replace(rest, CLASSES[i], ""), lambda r: step(i + 1, r)))

        return let(step(0, t), lambda n: F.transform(n, lambda x, i: (x - F.coalesce(F.get(n, i + 1), F.lit(0))).cast("long")))

    def histograms(words: Column) -> Column:
        plain = F.concat(F.lit(" "), F.replace(F.lower(F.array_join(words, " ")), F.lit(" "), F.lit("  ")), F.lit(" "))

        def count(p: Column) -> Column:
            def one(name: str) -> Column:
                each = F.transform(F.array(*[F.lit(f" {w} ") for w in COMMON[name]]), lambda w: ((F.octet_length(p) - F.octet_length(F.replace(p, w, F.lit("")))) / F.octet_length(w)).cast("long"))
                return let(each, lambda c: F.concat(c, F.array(F.size(words) - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))))

            return F.array(*[F.when(lang.isNull() | (lang == name), one(name)) for name in COMMON])

        return let(plain, count)

    def lines(t: Column) -> Column:
        full = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return let(full, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))

    def body(words: Column) -> Column:
        return let(
            classes(none),
            lambda c: F.struct(
                F.size(words).cast("long").alias("n_words"),
                (F.char_length(none).cast("long") - c[2]).alias("word_chars"),
                c[3].alias("n_symbols"),
                lines(none).alias("n_dup_lines"),
                repeated_words(words).alias("n_repeat_words"),
                c.alias("classes"),
                histograms(words).alias("common"),
            ),
        )

    return let(F.array_remove(F.split(none, SPACE), ""), body)


def base_failed(f: Column) -> Column:
    return (f["n_words"] < LEAST_WORDS) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def distance(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram of counts to a reference distribution."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)

    def part(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    parts = let(F.greatest(total, F.lit(1)), lambda n: F.zip_with(counts, F.array(*map(F.lit, reference)), lambda c, q: part(c / n, q)))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2))


def references(counted: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Per language, the class and common-word distributions over all documents of (lang, f) that pass the base rules. One row a language: a fixed few."""
    sums = []
    size = len(CLASSES) + 1
    for i, name in enumerate(COMMON):
        own = F.col("lang") == name
        sums += [F.sum(F.when(own, F.col("f.classes")[k])).alias(f"c{i}_{k}") for k in range(size)]
        sums += [F.sum(F.when(own, F.col("f.common")[i][k])).alias(f"w{i}_{k}") for k in range(len(COMMON[name]) + 1)]
    row = counted.where(~base_failed(F.col("f"))).agg(*sums).first()
    out = {}
    for i, name in enumerate(COMMON):
        c = [row[f"c{i}_{k}"] or 0 for k in range(size)]
        w = [row[f"w{i}_{k}"] or 0 for k in range(len(COMMON[name]) + 1)]
        if sum(c) and sum(w):
            out[name] = ([x / sum(c) for x in c], [x / sum(w) for x in w])
    return out


def verdict(f: Column, refs: dict[str, tuple[list[float], list[float]]]) -> Column:
    """Struct of the distances to the nearest reference, base_failed and kept. Without any reference the base rules decide."""
    kinds = [(F.lit(n), f["common"][list(COMMON).index(n)], *r) for n, r in refs.items()]
    none = F.lit(None).cast("struct<word:double,class:double,lang:string>")
    near = [F.when(common.isNotNull(), F.struct(distance(common, w).alias("word"), distance(f["classes"], c).alias("class"), name.alias("lang"))) for name, common, c, w in kinds]
    best = F.array_min(F.array(*near)) if near else none

    def judged(d: Column) -> Column:
        wide = F.lit(WORD_LIMIT) + F.lit(WORD_SLACK) / F.sqrt(F.greatest(f["n_words"], F.lit(1)))
        off = F.coalesce((d["word"] > wide) | (d["class"] > CLASS_LIMIT), F.lit(False))
        return F.struct(base_failed(f).alias("base_failed"), (~base_failed(f) & ~off).alias("kept"), d["class"].alias("class_distance"), d["word"].alias("word_distance"), d["lang"].alias("reference"))

    return let(best, judged)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame) -> DataFrame:
    """The rules' counts and verdict for each of docs (doc_id, text, lang, any other columns).

    Returns one row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, class_distance, word_distance, reference. A null text is empty and fails the base rules. A
    null lang is compared with the nearest reference; where there is none, and for a lang without a list of common
    words, the base rules decide.
    """
    counted = checkpoint(docs.select("doc_id", F.col("lang").alias("lang"), features(F.col("text"), F.col("lang")).alias("f")))
    v = verdict(F.col("f"), references(counted))
    return counted.select("doc_id", *[F.col(f"f.{c}").alias(c) for c in COUNTS], v.alias("v")).select("doc_id", *COUNTS, "v.*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they are."""
    prepare(docs.sparkSession)
    # counting costs far more than writing the documents once
    counted = written(docs.withColumn("_counted", features(F.col("text"), F.col("lang"))))
    refs = references(counted.select("lang", F.col("_counted").alias("f")))
    return counted.where(verdict(F.col("_counted"), refs)["kept"]).select(*docs.columns)


def oracle() -> str:
    """The same counts and verdicts in DuckDB's SQL."""
    words = ", ".join(f"('{n}', {i}, '{w}')" for n, ws in COMMON.items() for i, w in enumerate(ws))
    js = "sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, lang, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
x AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
t AS (SELECT r, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
n AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS twice FROM t WHERE w3 IS NOT NULL),
c AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM n, range(3) g(k) WHERE twice GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT s) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS s FROM d) WHERE regexp_matches(s, '[^\\x20\\x09-\\x0D]') GROUP BY r),
b AS (SELECT w.r, doc_id, lang, ws, text, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN l USING (r) LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
k AS (SELECT r, lang, base_failed, unnest([0, 1, 2, 3, 4, 5, 6]) AS bin, unnest([length(regexp_replace(text, '[^\\p{{Ll}}]', '', 'g')), length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')), length(text) - word_chars, n_symbols,
  length(regexp_replace(text, '[^\\p{{Nd}}]', '', 'g')), length(regexp_replace(regexp_replace(text, '[#*%&]', '', 'g'), '[^\\p{{P}}]', '', 'g')), NULL]) AS n, length(text) AS total FROM f),
cls AS (SELECT r, lang, base_failed, bin, coalesce(n, total - sum(n) OVER (PARTITION BY r)) AS n FROM k),
cw(name, bin, w) AS (VALUES {words}),
h AS (SELECT r, lower(w) AS w, count(*) AS n FROM x GROUP BY ALL),
m AS (SELECT r, name, bin, n FROM h JOIN cw USING (w)),
com AS (SELECT f.r, f.lang, f.base_failed, g.name, g.bin, coalesce(m.n, 0)::BIGINT AS n FROM f CROSS JOIN (SELECT name, bin FROM cw) g LEFT JOIN m ON m.r = f.r AND m.name = g.name AND m.bin = g.bin
  WHERE f.lang = g.name OR f.lang IS NULL),
com2 AS (SELECT * FROM com UNION ALL SELECT com.r, any_value(com.lang), any_value(com.base_failed), name, 99, any_value(f.n_words) - sum(n) FROM com JOIN f USING (r) GROUP BY com.r, name),
rc AS (SELECT lang AS name, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cls WHERE NOT base_failed GROUP BY lang, bin),
rw AS (SELECT name, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY name) AS q FROM com2 WHERE NOT base_failed AND lang = name GROUP BY name, bin),
pc AS (SELECT r, bin, n / greatest(sum(n) OVER (PARTITION BY r), 1) AS p FROM cls),
pw AS (SELECT r, name, bin, n / greatest(sum(n) OVER (PARTITION BY r, name), 1) AS p FROM com2),
jc AS (SELECT r, name, {js} AS jc FROM pc JOIN rc USING (bin) GROUP BY r, name),
jw AS (SELECT r, name, {js} AS jw FROM pw JOIN rw USING (name, bin) GROUP BY r, name),
j AS (SELECT r, arg_min(jc, (jw, jc, name)) AS jc, min(jw) AS jw FROM jw JOIN jc USING (r, name) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(jw > {WORD_LIMIT} + {WORD_SLACK} / sqrt(greatest(n_words, 1)) OR jc > {CLASS_LIMIT}, false) AS kept FROM f LEFT JOIN j USING (r)"""
