"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Measures are Spark expressions over the words (runs other than 0x20 and
0x09-0x0D) and lines of a text. Stop words are counted in lower case and without
the punctuation around them. RULES is the table of thresholds; a text is kept if it
passes the base rule and every row of the table.

Cases: a null or empty text has no words and fails the base rule. Lines without a
word don't count as lines. A rule with a ratio over 0 is passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
RUN = 5
#: Common words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in a is that for it as was with be on at by this an are from or not have had but "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat "
    "le la les de et à un une des en du est que pour qui dans ce il au sur se pas plus par avec "
    "el los las y del se un por con no una su para es al lo como más o pero sus"
).split()
PUNCTUATION = ".,;:!?()[]\"'"
SHORT_LINE = 20
#: (measure, least, most, words that a text has at least for the rule to apply); None: no bound.
RULES = (
    ("mean_word_length", 1.5, 25.0, 0),
    ("symbol_ratio", None, 0.1, 0),
    ("stop_word_ratio", 0.06, None, 20),
    ("dup_line_ratio", None, 0.5, 0),
    ("bullet_line_ratio", None, 0.9, 0),
    ("ellipsis_line_ratio", None, 0.3, 0),
    ("short_line_ratio", None, 0.8, 20),
)


def _ratio(a: str, b: str) -> Column:
    return F.expr(f"coalesce(try_divide({a}, {b}), 0)")


MEASURES = {
    "mean_word_length": lambda: _ratio("word_chars", "n_words"),
    "symbol_ratio": lambda: _ratio("n_symbols", "word_chars"),
    "stop_word_ratio": lambda: _ratio("n_stop_words", "n_words"),
    "dup_line_ratio": lambda: _ratio("n_dup_lines", "n_lines"),
    "bullet_line_ratio": lambda: _ratio("n_bullets", "n_lines"),
    "ellipsis_line_ratio": lambda: _ratio("n_ellipses", "n_lines"),
    "short_line_ratio": lambda: _ratio("n_short_lines", "n_lines"),
}


def compiled(rules=RULES) -> Column:
    """One condition from the table of thresholds."""
    verdict = F.lit(True)
    for measure, least, most, words in rules:
        value = MEASURES[measure]()
        inside = F.lit(True)
        if least is not None:
            inside = inside & (value >= least)
        if most is not None:
            inside = inside & (value <= most)
        verdict = verdict & (inside | (F.col("n_words") < words))
    return verdict


def judge(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.struct("*").alias("doc"), body.alias("body"))
    rows = rows.withColumn("words", F.filter(F.split("body", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = rows.withColumn("lines", F.filter(F.split("body", "\n"), lambda line: F.translate(line, SPACES, "") != ""))
    # each word is hashed once, a window by the hashes of its words
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    gram = lambda i: F.xxhash64(*[F.get("hashes", i + j) for j in range(RUN)])
    rows = rows.withColumn("grams", F.when(F.size("words") >= RUN, F.transform(F.sequence(F.lit(0), F.size("words") - RUN), gram)).otherwise(F.array().cast("array<bigint>")))
    # windows are sorted only where one of them occurs twice
    ordered = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    rows = rows.withColumn("ordered", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), ordered))
    twice = F.filter("ordered", lambda x, j: F.coalesce(F.get("ordered", j - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get("ordered", j + 1)["g"] == x["g"], F.lit(False)))
    rows = rows.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covers = F.transform("starts", lambda s, j: F.least(F.lit(RUN), F.coalesce(F.get("starts", j + 1) - s, F.lit(RUN))))
    repeats = F.coalesce(F.aggregate(covers, F.lit(0), lambda a, b: a + b), F.lit(0))
    counted = lambda test: F.size(F.filter("lines", test))
    measured = rows.select(
        "doc",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("body", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.btrim(F.lower(w), F.lit(PUNCTUATION)).isin(*dict.fromkeys(STOP_WORDS)))).alias("n_stop_words"),
        counted(lambda line: F.ltrim(line, F.lit(SPACES)).substr(1, 1).isin("-", "*", "•")).alias("n_bullets"),
        counted(lambda line: F.rtrim(line, F.lit(SPACES)).endswith("...") | F.rtrim(line, F.lit(SPACES)).endswith("…")).alias("n_ellipses"),
        counted(lambda line: F.length(line) < SHORT_LINE).alias("n_short_lines"),
    )
    measured = measured.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    kept = [F.col(f"doc.`{c}`") for c in docs.columns if c.lower() not in [*names, "kept"]]
    return measured.select(*kept, *names, (~F.col("base_failed") & compiled(rules)).alias("kept"))
