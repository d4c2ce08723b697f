"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import beside, let, plain_words

WINDOW = 5

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do "
    "le la les de des du et un une en est que qui dans pour par sur au aux ce se ne pas plus il elle on nous vous ils avec sont comme mais ou leur cette être "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum haben nur oder aber vor zur bis "
    "el los las y que del se con para una su al lo como más pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos"
).split()


@dataclass(frozen=True)
class Rule:
    """A document of from_words words or more fails where the measure is under least or over most."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The threshold table. Measures are columns of measures().
RULES = (
    Rule("mean_word_length", "mean_word_length", 1.5, 20.0),
    Rule("symbol_ratio", "symbol_ratio", None, 0.3),
    Rule("letter_word_ratio", "letter_word_ratio", 0.5, None),
    Rule("stop_word_ratio", "stop_word_ratio", 0.005, None, from_words=20),
    Rule("dup_line_ratio", "dup_line_ratio", None, 0.5),
    Rule("ellipsis_line_ratio", "ellipsis_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", "bullet_line_ratio", None, 0.9),
    Rule("upper_word_ratio", "upper_word_ratio", None, 0.6),
)


def _repeated_words(words: Column) -> Column:
    """Words within WINDOW-word windows that occur twice or more.

    Windows are hashed; only where some hash repeats are (hash, start) pairs sorted, repeated starts picked by their neighbours and the union of their extents summed.
    """

    def covered(starts: Column) -> Column:
        n = F.size(starts)
        gap = lambda i: F.least(F.lit(WINDOW), F.get(starts, i + 1) - F.get(starts, i))
        return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(F.slice(F.sequence(F.lit(0), n - 1), 1, n - 1), F.lit(WINDOW), lambda total, i: total + gap(i)))

    def repeated(pairs: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, j)["h"], F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: same(i, i + 1) | same(i, i - 1))
        return let(F.array_sort(F.transform(at, lambda i: F.get(pairs, i)["i"])), covered)

    def by_hash(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, repeated))

    def windows(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(ws) - WINDOW)
        return let(F.transform(starts, lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(WINDOW)))), by_hash)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(hashed, windows)).cast("long")


def _counts(words: Column, lines: Column, text: Column) -> Column:
    n_words, n_lines = F.size(words).cast("long"), F.size(lines).cast("long")
    share = lambda items, test: F.try_divide(F.size(F.filter(items, test)).cast("double"), F.size(items))
    # words of a form, counted in the text itself: one pass of a pattern that begins and ends with a word
    counted = lambda pattern: F.try_divide(F.regexp_count(text, F.lit(pattern)).cast("double"), n_words)
    return F.struct(
        n_words.alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        _repeated_words(words).alias("n_repeat_words"),
        n_lines.alias("n_lines"),
        share(words, lambda w: F.lower(w).isin(STOP_WORDS)).alias("stop_word_ratio"),
        counted("(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0DA-Za-z\\x{80}-\\x{10FFFF}]*+[A-Za-z\\x{80}-\\x{10FFFF}][^\\x20\\x09-\\x0D]*+").alias("letter_word_ratio"),
        counted("(?<![^\\x20\\x09-\\x0D])[^a-z\\x20\\x09-\\x0D\\x{80}-\\x{10FFFF}]*[A-Z]{2}[^a-z\\x20\\x09-\\x0D\\x{80}-\\x{10FFFF}]*+(?![^\\x20\\x09-\\x0D])").alias("upper_word_ratio"),
        share(lines, lambda s: s.rlike("(\\.\\.\\.|\\x{2026})[\\x20\\x09-\\x0D]*$")).alias("ellipsis_line_ratio"),
        share(lines, lambda s: s.rlike("^[\\x20\\x09]*[-*\\x{2022}]")).alias("bullet_line_ratio"),
    )


def _with_ratios(m: Column) -> Column:
    share = lambda part, whole: F.try_divide(m[part].cast("double"), m[whole])
    return m.withField("mean_word_length", share("word_chars", "n_words")).withField("symbol_ratio", share("n_symbols", "n_words")).withField("dup_line_ratio", share("n_dup_lines", "n_lines"))


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row of measures breaks, in table order."""
    broken = []
    for rule in rules:
        under = m[rule.measure] < F.lit(rule.least) if rule.least is not None else F.lit(False)
        over = m[rule.measure] > F.lit(rule.most) if rule.most is not None else F.lit(False)
        broken.append(F.when(F.coalesce((under | over) & (m["n_words"] >= rule.from_words), F.lit(False)), F.lit(rule.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def base_failed(m: Column, least_words: int = 10, most_repeat_percent: int = 20) -> Column:
    return (m["n_words"] < least_words) | (100 * m["n_repeat_words"] > most_repeat_percent * m["n_words"])


def quality_of(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the counts and ratios of a whole text, base_failed, kept and the broken rules, as one expression.

    Each step is bound once and read by the next, so a filter on the result does not repeat what it stands on. A ratio
    with an empty denominator is null, and a null measure breaks no rule.
    """
    body = F.coalesce(text, F.lit(""))
    parts = F.struct(plain_words(body).alias("words"), F.filter(F.split(body, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    judged = lambda m: m.withField("base_failed", base_failed(m)).withField("broken", verdict(m, rules))
    ended = lambda q: q.withField("kept", ~q["base_failed"] & (F.size(q["broken"]) == 0))
    return let(parts, lambda p: let(_counts(p["words"], p["lines"], body), lambda c: let(_with_ratios(c), lambda m: let(judged(m), ended))))


def assess(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with a struct column `quality`: n_words, the counts, base_failed, kept and the broken rules.

    One projection, no shuffle. Null or empty text has no words: base_failed, not kept. Repeated rows are judged
    alike; further columns stay, and a column already called `quality` is then called `quality_in`.
    """
    own = docs.toDF(*beside(docs.columns, ("quality",)))
    return own.withColumn("quality", quality_of(F.col(own.columns[docs.columns.index(text)]), rules))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with the columns of docs. Row order and repeated rows stay."""
    return docs.where(quality_of(F.col(text), rules)["kept"])
