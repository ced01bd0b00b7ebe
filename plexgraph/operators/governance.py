"""Profiles, quality rules, source rules, access control, drift and result shaping."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column-name parts that point to personal data, and its kind (fixed values).
PII_NAMES = {
    "email": "email", "mail": "other", "phone": "phone", "mobile": "phone", "tel": "phone", "name": "name", "birth": "birth_date", "dob": "birth_date",
    "ssn": "national_id", "resident": "national_id", "rrn": "national_id", "address": "address", "addr": "address", "street": "address", "zip": "address", "postal": "address",
}
#: How kinds of personal data are classified (fixed values); other kinds are internal.
CLASSIFICATION = {"email": "confidential", "phone": "confidential", "name": "confidential", "address": "confidential", "national_id": "restricted", "birth_date": "restricted"}


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, n_null, n_distinct, lowest, highest): lowest and highest of the text form, in one pass."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts.append(F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_distinct(text).alias("n_distinct"), F.min(text).alias("lowest"), F.max(text).alias("highest")))
    return rows.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def sample_values(rows: DataFrame, column: str, n: int = 30) -> DataFrame:
    """The n least distinct values of a column."""
    return rows.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().orderBy("value").limit(n)


def edge_profile(edges: DataFrame) -> DataFrame:
    """One row: n_edges, n_sources, avg_degree."""
    degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    return degrees.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("n_edges"), F.count(F.lit(1)).alias("n_sources"), F.avg("d").alias("avg_degree"))


def _scored(rule: str, counts: DataFrame, threshold: float) -> DataFrame:
    score = F.when(F.col("total") == 0, F.lit(100.0)).otherwise((F.col("total") - F.col("violations")) / F.col("total") * 100)
    return counts.select(F.lit(rule).alias("rule"), "violations", "total", score.alias("score"), (score >= threshold).alias("passed"))


def completeness(rows: DataFrame, column: str, threshold: float = 1.0) -> DataFrame:
    return _scored("completeness", rows.agg(F.count_if(F.col(column).isNull()).alias("violations"), F.count(F.lit(1)).alias("total")), threshold)


def consistency(rows: DataFrame, column: str, threshold: float = 1.0) -> DataFrame:
    return completeness(rows, column, threshold).withColumn("rule", F.lit("consistency"))


def uniqueness(rows: DataFrame, column: str, threshold: float = 1.0) -> DataFrame:
    """Rows of values that occur more than once; nulls are one value."""
    groups = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return _scored("uniqueness", groups.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("violations"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")), threshold)


def freshness(rows: DataFrame, column: str | None = None, threshold: float = 1.0) -> DataFrame:
    if column:
        return completeness(rows, column, threshold).withColumn("rule", F.lit("freshness"))
    empty = rows.limit(1).agg((F.lit(1) - F.count(F.lit(1))).alias("violations"), F.lit(1).cast("long").alias("total"))
    return _scored("freshness", empty, threshold)


def implied_keys(schemas: dict[str, list[str]]) -> list[tuple[str, str, str]]:
    """(table, column, table it refers to) by names: x_id for a table x, xs, xes or, of y, ies."""
    found = []
    for table, columns in schemas.items():
        for column in columns:
            if column.lower().endswith("_id"):
                stem = column.lower()[:-3]
                names = [stem, stem + "s", stem + "es"] + ([stem[:-1] + "ies"] if stem.endswith("y") else [])
                found += [(table, column, t) for t in schemas if t.lower() in names and t != table][:1]
    return found


def pii_columns(columns: list[str]) -> list[str]:
    return [c for c, _ in pii_kinds(columns)]


def pii_kinds(columns: list[str]) -> list[tuple[str, str]]:
    """(column, kind of personal data) by the parts of a name between underscores; of several the one first in PII_NAMES counts."""
    found = []
    for c in columns:
        parts = c.lower().split("_")
        kinds = [kind for part, kind in PII_NAMES.items() if part in parts]
        found += [(c, kinds[0])] if kinds else []
    return found


def classification(kind: str) -> str:
    return CLASSIFICATION.get(kind, "internal")


def decided(samples: DataFrame, decisions: list[tuple[str, str]]) -> DataFrame:
    """samples (column, values) after decisions (column, mask, exclude or allow); the last one of a column counts."""
    last = dict(decisions)
    masked, excluded = ([c for c, d in last.items() if d == kind] for kind in ("mask", "exclude"))
    values = F.when(F.col("column").isin(masked), F.transform("values", lambda x: F.lit("[MASKED]"))).when(F.col("column").isin(excluded), F.array().cast("array<string>")).otherwise(F.col("values"))
    return samples.select("column", values.alias("values"))


def looks_like_email(value: Column) -> Column:
    return value.contains("@") & value.contains(".") & (F.length(value) > 5)


def ambiguous_codes(rows: DataFrame, column: str) -> DataFrame:
    """One row: whether a column is probably a code without an explanation.

    That is a column of whole numbers, of 2 to 20 distinct values and not an id; or of
    texts of which some are one or two capital letters and others are longer.
    """
    text = F.col(column).cast("string")
    whole = F.count_if(text.isNotNull() & ~text.rlike(r"\A-?\d+\z")) == 0
    short = F.count_if(text.rlike(r"\A[A-Z]{1,2}\z"))
    is_id = column.lower() == "id" or column.lower().endswith("_id")
    numeric = whole & F.count_distinct(column).between(2, 20) & F.lit(not is_id)
    opaque = (short > 0) & (F.count_if(F.length(text) > 2) > 0)
    return rows.agg(F.count_distinct(column).alias("n_distinct"), numeric.alias("numeric"), opaque.alias("opaque")).select(F.lit(column).alias("column"), "n_distinct", (F.col("numeric") | F.col("opaque")).alias("ambiguous"))


def deny(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.drop(*columns)


def mask(rows: DataFrame, columns: list[str], pattern: str = "***", denied: tuple[str, ...] = ()) -> DataFrame:
    """Masked columns; a denied column goes, whether masked or not."""
    return rows.withColumns({c: F.lit(pattern) for c in columns if c in rows.columns}).drop(*denied)


#: Changes of type that lose nothing (fixed values).
WIDENINGS = {("bigint", "double"), ("int", "double"), ("int", "bigint"), ("date", "timestamp"), ("boolean", "int"), ("boolean", "bigint")}


def drift(was: dict[str, str], now: dict[str, str]) -> list[tuple[str, str]]:
    """(column, added, removed, widened or breaking) between two schemas of name and type."""
    found = [(c, "added") for c in sorted(now.keys() - was.keys())] + [(c, "removed") for c in sorted(was.keys() - now.keys())]
    for c in sorted(was.keys() & now.keys()):
        if was[c] != now[c]:
            found.append((c, "widened" if now[c] == "string" or (was[c], now[c]) in WIDENINGS else "breaking"))
    return found


def audit(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(label, state): matched, missing or orphan, of two tables of labels."""
    a, b = expected.select("label").distinct().withColumn("e", F.lit(1)), actual.select("label").distinct().withColumn("a", F.lit(1))
    return a.join(b, "label", "full").select("label", F.when(F.col("e").isNull(), "orphan").when(F.col("a").isNull(), "missing").otherwise("matched").alias("state"))


def histogram(rows: DataFrame, column: str, most: int = 20) -> DataFrame:
    """(bin, n): equal bins, at most the square root of the number of values."""
    stats = rows.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.least(F.lit(most), F.ceil(F.sqrt(F.count(column)))).alias("bins"))
    place = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("low")) / (F.col("high") - F.col("low")) * F.col("bins")), F.col("bins") - 1))
    return rows.where(F.col(column).isNotNull()).crossJoin(F.broadcast(stats)).groupBy(place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def heatmap(rows: DataFrame, y: str, x: str, value: Column, values: list[str]) -> DataFrame:
    return rows.groupBy(y).pivot(x, values).agg(value)


def last_cell(value: str, order: Column) -> Column:
    """For a heatmap: of several values of a cell the last by an order."""
    return F.max_by(value, order)


def name_values(rows: DataFrame, name: str, value: str) -> DataFrame:
    """(name, value): a missing name is empty, a value that is missing or no number is 0."""
    return rows.select(F.coalesce(F.col(name).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(value).try_cast("double"), F.lit(0.0)).alias("value"))


#: Parts of column names that a funnel and a timeline look for, the first that fits (fixed values).
STAGES, VALUES = ("stage", "name", "step", "label", "phase", "status"), ("value", "count", "total", "amount", "users", "sessions")
DATES = ("date", "time", "timestamp", "created", "at")


def named_column(rows: DataFrame, parts: tuple[str, ...], types: tuple[str, ...]) -> str | None:
    """The first column whose name has one of the parts, else the first of one of the types."""
    for part in parts:
        for c in rows.columns:
            if part in c.lower():
                return c
    return next((c for c, t in rows.dtypes if t in types), None)


NUMBERS = ("int", "bigint", "double", "float")


def funnel(rows: DataFrame) -> DataFrame:
    """(stage, value) of the columns whose names say so, the largest value first."""
    stage, value = named_column(rows, STAGES, ("string",)), named_column(rows, VALUES, NUMBERS)
    return name_values(rows, stage, value).withColumnRenamed("name", "stage").orderBy(F.desc("value"), "stage")


def timeline(rows: DataFrame) -> DataFrame:
    """(at, label) in order of the column of times."""
    at, label = named_column(rows, DATES, ("date", "timestamp", "timestamp_ntz")), named_column(rows, STAGES, ("string",))
    return rows.select(F.col(at).alias("at"), F.col(label).cast("string").alias("label")).where("at is not null").orderBy("at", "label")


def level(value: Column, warning: float | None = None, critical: float | None = None, above: bool = True) -> Column:
    """critical, warning or normal by bounds that a value reaches from below, or from above."""
    reaches = (lambda bound: value >= bound) if above else (lambda bound: value <= bound)
    out = F.lit("normal")
    for name, bound in (("warning", warning), ("critical", critical)):
        out = F.when(reaches(bound), name).otherwise(out) if bound is not None else out
    return out


def custom_rule(counts: DataFrame, threshold: float = 1.0, rule: str = "custom") -> DataFrame:
    """A rule of one's own: one row with violations and total, by name or as the first two columns."""
    names = [c if c in counts.columns else counts.columns[k] for k, c in enumerate(("violations", "total"))]
    return _scored(rule, counts.select(F.col(names[0]).cast("long").alias("violations"), F.col(names[1]).cast("long").alias("total")), threshold)


def run_rules(spark, rules: dict) -> DataFrame:
    """(rule, violations, total, score, passed, error) of rules by name, each a function that gives a scored row; one that fails gives its error."""
    rows = []
    for name, rule in rules.items():
        try:
            found = rule().first()
            rows.append((name, found["violations"], found["total"], found["score"], found["passed"], None))
        except Exception as failure:  # noqa: BLE001 - a rule is a user's code, and its failure is a result
            rows.append((name, None, None, None, False, type(failure).__name__))
    return spark.createDataFrame(rows, "rule string, violations long, total long, score double, passed boolean, error string")


def column_statistics(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_null, n_distinct, lowest, highest, sampled) in one pass; binary columns have their nulls counted only.

    sampled says whether values may be shown: up to 30 distinct ones always, up to 100
    if they are 50 characters long at most on average.
    """
    parts = []
    for c, kind in rows.dtypes:
        if columns is None or c in columns:
            text = F.col(c).cast("string")
            n = F.count_distinct(text) if kind != "binary" else F.lit(None).cast("long")
            low, high = (F.min(text), F.max(text)) if kind != "binary" else (F.lit(None).cast("string"), F.lit(None).cast("string"))
            sampled = (n <= 30) | ((n <= 100) & (F.coalesce(F.avg(F.length(text)), F.lit(0.0)) <= 50)) if kind != "binary" else F.lit(False)
            parts.append(F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null"), n.alias("n_distinct"), low.alias("lowest"), high.alias("highest"), sampled.alias("sampled")))
    return rows.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def sampled_values(rows: DataFrame, column: str, most: int = 100, characters: int = 200) -> DataFrame:
    """The distinct values of a column by the policy of column_statistics, cut to 200 characters; none where it forbids them."""
    allowed = column_statistics(rows, [column]).select("sampled")  # one row
    values = rows.select(F.left(F.col(column).cast("string"), F.lit(characters)).alias("value")).where("value is not null").distinct().orderBy("value").limit(most)
    return values.join(F.broadcast(allowed.where("sampled")), how="cross").select("value")


def enrichment(statistics: DataFrame) -> DataFrame:
    """(column, text): what a profile says of a column, its range or that it is empty or has one value."""
    text = F.when(F.col("n_distinct") == 0, "empty").when(F.col("n_distinct") == 1, F.concat(F.lit("always "), "lowest")).otherwise(F.concat(F.lit("from "), "lowest", F.lit(" to "), "highest", F.lit(", "), F.col("n_distinct").cast("string"), F.lit(" values")))
    return statistics.select("column", text.alias("text"))


MARK = " | profile: "


def enriched(description: str | None, text: str) -> str:
    """A description with a profile's text; an earlier one is replaced."""
    manual = (description or "").split(MARK)[0].strip()
    return f"{manual}{MARK}{text}" if manual else f"{MARK.strip()} {text}"


def masked_map(rows: DataFrame, column: str, masked: list[str], denied: list[str], pattern: str = "***") -> DataFrame:
    """rows with keys of a map column denied (gone) or masked; denied wins."""
    kept = F.map_filter(F.col(column), lambda k, v: ~k.isin(denied)) if denied else F.col(column)
    return rows.withColumn(column, F.transform_values(kept, lambda k, v: F.when(k.isin(masked), F.lit(pattern)).otherwise(v)) if masked else kept)


def effective_policies(policies: DataFrame, role: str, workspace_role: str, user: str) -> DataFrame:
    """Active policies (subject_kind, subject, active, priority) of a role, a role in the workspace or a user, the most important first."""
    of = lambda kind, subject: (F.col("subject_kind") == kind) & (F.col("subject") == subject)
    return policies.where(F.col("active") & (of("role", role) | of("workspace_role", workspace_role) | of("user", user))).orderBy(F.desc("priority"), "subject_kind", "subject")


def synchronous(states: DataFrame) -> DataFrame:
    """One row: the share of labels that are matched, in whole percent, cut off; 100 of none."""
    return states.agg(F.expr("coalesce(cast(floor(try_divide(count_if(state = 'matched') * 100, count(*))) as bigint), 100)").alias("sync_percent"))


def schema_checksum(schema: dict[str, str]) -> str:
    """A hash of names and types that doesn't depend on the order of columns."""
    return hashlib.sha256(";".join(f"{name.lower()}:{kind.lower()}" for name, kind in sorted(schema.items())).encode()).hexdigest()


def union_of(rules: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)
