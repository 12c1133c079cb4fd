"""Quality rules as a short-circuit cascade, with DataFrame functions alone."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from correspond.llm.common import table, words_of

WINDOW = 3
#: Characters that count as symbols. Fixed values.
SYMBOLS = "#*$%&|<>"
_FULL = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def full_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_FULL))


def repeat_words(words: Column) -> Column:
    """Words in WINDOW-word windows that occur twice or more.

    Windows are hashed, and hash and place packed in one number, so that one sort of
    numbers brings windows of one hash together. What that leaves are all twins and
    the few that share hash bits by chance; these alone are sorted as text, which decides.
    """
    n = F.size(words)
    places = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n))) - 1
    word = lambda i, k: F.get(words, i + k)
    zero = F.lit(0).cast("long")

    def packed(mask: Column) -> Column:
        starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
        return F.sort_array(F.transform(starts, lambda i: F.coalesce(F.xxhash64(*(word(i, k) for k in range(WINDOW))).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")), zero)))

    def candidates(p: Column, mask: Column) -> Column:
        near = lambda x, k: F.coalesce(F.get(p, k).bitwiseXOR(x).between(0, mask), F.lit(False))
        return F.transform(F.filter(p, lambda x, k: near(x, k - 1) | near(x, k + 1)), lambda x: x.bitwiseAND(mask).cast("int"))

    def confirmed(m: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(m, k)["s"] == x["s"], F.lit(False))
        return F.sort_array(F.transform(F.filter(m, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"].cast("long")))

    named = lambda at: F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws(" ", *(word(i, k) for k in range(WINDOW))).alias("s"), i.alias("i"))))
    start = F.struct(F.lit(-WINDOW).cast("long").alias("at"), zero.alias("n"))
    step = lambda s, x: F.struct(x.alias("at"), (s["n"] + F.least(F.lit(WINDOW).cast("long"), x - s["at"])).alias("n"))
    again = let(places, lambda mask: let(packed(mask), lambda p: let(named(candidates(p, mask)), confirmed)))
    return F.aggregate(again, start, step, lambda s: s["n"])


#: Figures of a text, from its text (not null) and words.
FIGURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words).cast("long"),
    "word_chars": lambda text, words: F.char_length(F.array_join(words, "")).cast("long"),
    "n_symbols": lambda text, words: (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
    "n_lines": lambda text, words: F.size(full_lines(text)).cast("long"),
    "n_dup_lines": lambda text, words: let(full_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    "n_repeat_words": lambda text, words: repeat_words(words),
    "n_lettered": lambda text, words: F.size(F.filter(words, lambda w: w.rlike(r"[A-Za-z]|[^\x00-\x7F]"))).cast("long"),
    "n_open_lines": lambda text, words: F.size(F.filter(full_lines(text), lambda x: x.rlike(r"(\.\.\.|\x{2026})[\x20\x09-\x0D]*\z"))).cast("long"),
    "n_listed_lines": lambda text, words: F.size(F.filter(full_lines(text), lambda x: x.rlike(r"^[\x20\x09-\x0D]*([-*]|\x{2022})[\x20\x09]"))).cast("long"),
}
#: What the query returns of every document.
RETURNED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """name; fails: a condition on the figures; uses: names of the figures; steps: what they cost, in steps by characters, words and lines of a text."""

    name: str
    fails: Callable[[dict[str, Column]], Column]
    uses: tuple[str, ...]
    steps: Callable[[Column, Column], Column]


_CHARS, _WORDS = (lambda text, words: F.char_length(text)), (lambda text, words: F.size(words))
#: The first two are fixed by the contract of the query; the others reject junk alone: decorated words, repeated lines,
#: run-together or broken words, texts of figures, cut-off lines, bare lists.
RULES = (
    Rule("few_words", lambda f: f["n_words"] < 50, ("n_words",), lambda text, words: F.lit(1)),
    Rule("repeats", lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"], ("n_repeat_words", "n_words"), lambda text, words: 16 * F.size(words)),
    Rule("symbols", lambda f: 100 * f["n_symbols"] > 50 * f["n_words"], ("n_symbols", "n_words"), _CHARS),
    Rule("repeated_lines", lambda f: 2 * f["n_dup_lines"] > f["n_lines"], ("n_dup_lines", "n_lines"), lambda text, words: 2 * F.char_length(text)),
    Rule("word_length", lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 25 * f["n_words"]), ("word_chars", "n_words"), _WORDS),
    Rule("letters", lambda f: 2 * f["n_lettered"] < f["n_words"], ("n_lettered", "n_words"), lambda text, words: 4 * F.size(words)),
    Rule("cut_off_lines", lambda f: 10 * f["n_open_lines"] > 3 * f["n_lines"], ("n_open_lines", "n_lines"), lambda text, words: 3 * F.char_length(text)),
    Rule("bare_list", lambda f: 10 * f["n_listed_lines"] > 9 * f["n_lines"], ("n_listed_lines", "n_lines"), lambda text, words: 3 * F.char_length(text)),
)


def ordered_rules(docs: DataFrame, rules=RULES, sample_rows: int = 1000, known: tuple[str, ...] = ()) -> list[tuple[Rule, float, float]]:
    """(rule, steps a document, rejected share) in the order of rejection per cost, on a sample of sample_rows documents by hash.

    A rule's rejections are those of the documents that the rules before it let pass.
    Figures in `known` are at hand and cost one step. Cost is counted, not timed, so
    that reruns agree; the order decides what is worked out, never whether a document is kept.
    """
    text = F.coalesce("text", F.lit(""))
    n = docs.count()
    order = F.xxhash64(F.lit(23), F.col("text"))
    drawn = docs.select("text").where(order % (1 << 30) / float(1 << 30) < 2.4 * sample_rows / max(1, n) - 1).orderBy(order, "text").limit(sample_rows)
    rows = drawn.select(text.alias("_text"), words_of(text).alias("_words"))
    figures = {name: f(F.col("_text"), F.col("_words")) for name, f in FIGURES.items()}
    free = lambda rule: set(rule.uses) <= set(known)
    steps = [F.avg(F.lit(1.0) if free(r) else r.steps(F.col("_text"), F.col("_words"))) for r in rules]
    seen = rows.select(*(F.coalesce(r.fails(figures), F.lit(False)).alias(f"f{k}") for k, r in enumerate(rules)))
    patterns = [tuple(r) for r in seen.groupBy(*seen.columns).count().collect()] if rules else []  # at most sample_rows rows
    costs = [max(1.0, c or 0.0) for c in rows.agg(*steps).first()] if rules else []
    left, found, total = list(range(len(rules))), [], max(1, sum(p[-1] for p in patterns))
    while left:
        hits = {k: sum(p[-1] for p in patterns if p[k]) for k in left}
        best = max(left, key=lambda k: (hits[k] / costs[k], -costs[k], -k))
        found.append((rules[best], costs[best], hits[best] / total))
        patterns = [p for p in patterns if not p[best]]
        left.remove(best)
    return found


def cascade(docs: DataFrame, rules) -> DataFrame:
    """docs(text, ...) and rejected_by, the first rule in the given order that a document fails (null: none), and kept.

    One CASE whose conditions hold the figures of their own rules: what a rule needs
    is worked out for documents that all earlier rules let pass, and for no others.
    A figure that is a column of docs already is taken as it is.
    """
    own = set(docs.columns)
    docs = docs.withColumn("_text", F.coalesce("text", F.lit(""))) if "_text" not in own else docs
    docs = docs.withColumn("_words", words_of(F.col("_text"))) if "_words" not in own else docs
    figures = {name: F.col(name) if name in own else f(F.col("_text"), F.col("_words")) for name, f in FIGURES.items()}
    verdict = None
    for rule in rules:
        hit = F.coalesce(rule.fails(figures), F.lit(False))
        verdict = F.when(hit, rule.name) if verdict is None else verdict.when(hit, rule.name)
    verdict = F.lit(None).cast("string") if verdict is None else verdict
    return docs.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull()).drop(*({"_text", "_words"} - own))


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by), a row for each row of docs.

    The five figures are those of all documents; the rules whose figures are not
    among them run in the cascade's order on what earlier ones let pass. rejected_by
    names the first rule that a document fails. Null and empty texts have no words and
    fail; texts of any length are counted whole; repeated rows are judged alike; an
    empty table gives none; other columns are not read.
    """
    order = [rule for rule, _, _ in ordered_rules(docs, rules, known=RETURNED)]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"), words_of(text).alias("_words"), F.col("text"))
    rows = rows.select("*", *(FIGURES[c](F.col("_text"), F.col("_words")).alias(c) for c in RETURNED))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return cascade(rows, order).select("doc_id", *RETURNED, base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "rejected_by")


def op3_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).drop("rejected_by")
