"""Quality rules as weak supervision: votes, accuracies by expectation-maximisation, posterior verdicts. Native throughout.

Each rule votes good, bad or abstains on a document. Documents with the same votes are alike, so EM runs over the table of
vote patterns, which has at most 3**rules rows however large the corpus is; a job of one aggregate is one iteration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import BLANKS, checkpointed, stored, words

#: Rules: name, measure (SQL), bad above, good at most; between the two the rule abstains.
RULES = (
    ("symbols", "n_symbols / greatest(n_words, 1)", 0.2, 0.05),
    ("marks", "n_marks / greatest(word_chars, 1)", 0.2, 0.1),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", 0.3, 0.1),
    ("lines", "n_dup_lines / greatest(n_lines, 1)", 0.4, 0.1),
    ("capitals", "n_capitals / greatest(word_chars, 1)", 0.4, 0.15),
    ("digits", "n_digits / greatest(word_chars, 1)", 0.3, 0.05),
    ("word_length", "abs(word_chars / greatest(n_words, 1) - 6.0)", 6.0, 3.0),
    ("shortness", "50.0 / greatest(n_words, 1)", 1.0, 0.5),
)
ITERATIONS = 10
#: What EM starts from: share of good documents; chances of the votes (good, bad) on good and on bad documents. A rule looks for
#: one fault, so most rules also like most bad documents. WEIGHT: of these chances, in documents.
PRIOR, ON_GOOD, ON_BAD, WEIGHT = 0.8, (0.6, 0.02), (0.5, 0.3), 10.0

BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def vote(rule: tuple[str, str, float, float]) -> str:
    """SQL of a rule's vote: 1 good, -1 bad, 0 abstains."""
    _, measure, bad, good = rule
    return f"CASE WHEN {measure} > {bad} THEN -1 WHEN {measure} <= {good} THEN 1 ELSE 0 END"


def posterior(prior: str, chances: list[tuple[str, str, str, str]]) -> str:
    """SQL of the probability of good, given the votes v0, v1, ... and each rule's chances of voting good and bad on good
    documents, then on bad ones. Abstaining has the rest."""

    def product(share: str, at: int) -> str:
        return " * ".join([share, *(f"CASE v{i} WHEN 1 THEN {c[at]} WHEN -1 THEN {c[at + 1]} ELSE 1 - {c[at]} - {c[at + 1]} END" for i, c in enumerate(chances))])

    good, bad = product(prior, 0), product(f"(1 - {prior})", 2)
    return f"(({good}) / (({good}) + ({bad})))"


def updates(p: str, rules: int) -> list[str]:
    """SQL of EM's next values over patterns of n documents, given the posterior p: prior, then each rule's four chances."""
    out = [f"(sum(n * {p}) + {PRIOR} * {WEIGHT}) / (sum(n) + {WEIGHT})"]
    for i in range(rules):
        for q, start in ((p, ON_GOOD), (f"(1 - {p})", ON_BAD)):
            for v, chance in zip((1, -1), start):
                out.append(f"(sum(CASE WHEN v{i} = {v} THEN n * {q} ELSE 0.0 END) + {chance} * {WEIGHT}) / (sum(n * {q}) + {WEIGHT})")
    return out


def measured(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key and measures of each text (null: no words).

    A window is three following words; the words of windows found twice or more count once each. Windows are known by a 64-bit
    hash and sorted with their places, so n words cost n log n.
    """

    def less(pattern: str):
        return (F.length("bare") - F.length(F.regexp_replace("bare", pattern, ""))).cast("long")

    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = docs.select(F.col(f"`{key}`"), words(t).alias("w"), F.translate(t, BLANKS, "").alias("bare"), F.filter(F.split(t, "\n"), lambda x: F.translate(x, BLANKS, "") != "").alias("l"))
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    df = df.withColumn("h", F.when(F.size("w") >= 3, hashes).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.filter("s", lambda x, i: F.coalesce(x["h"] == F.get("s", i + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("s", i - 1)["h"], F.lit(False)))
    df = df.withColumn("i", F.sort_array(F.transform(same, lambda x: x["i"])))
    covered = F.aggregate(F.transform("i", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("i", i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(
        key,
        F.size("w").cast("long").alias("n_words"),
        F.length("bare").cast("long").alias("word_chars"),
        (F.length("bare") - F.length(F.translate("bare", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        less("[^\\p{L}\\p{N}]+").alias("n_marks"),
        less("\\p{Lu}+").alias("n_capitals"),
        less("[0-9]+").alias("n_digits"),
    )


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", rules=RULES, iterations: int = ITERATIONS) -> DataFrame:
    """Key, measures, `probability` (of good), `base_failed` and `kept` of each document.

    kept: not base_failed and a probability of at least 0.5. Null and empty texts have no words and fail; repeated rows are
    judged each; very long texts are measured whole (n words cost n log n); other columns are not carried, so none can clash. An empty
    table gives no rows.
    """
    votes = [F.expr(vote(r)).alias(f"v{i}") for i, r in enumerate(rules)]
    df = stored(measured(docs, text, key).select(key, *MEASURES, *votes), "votes")  # texts are read once; EM and verdicts need a few numbers
    names = [f"v{i}" for i in range(len(rules))]
    patterns = checkpointed(df.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("n")))
    values = [PRIOR, *(ON_GOOD + ON_BAD) * len(rules)]
    for _ in range(iterations):
        p = posterior(*_literals(values))
        found = patterns.select(*names, "n", F.expr(p).alias("p")).agg(*(F.expr(x) for x in updates("p", len(rules)))).first()
        values = [v if x is None else x for v, x in zip(values, found)]
    failed = F.expr(BASE_FAILED)
    df = df.withColumn("probability", F.expr(posterior(*_literals(values)))).withColumn("base_failed", failed)
    return df.select(key, *MEASURES, "probability", "base_failed", (~failed & (F.col("probability") >= 0.5)).alias("kept"))


def _literals(values: list[float]) -> tuple[str, list[tuple[str, str, str, str]]]:
    text = [f"{v!r}D" for v in values]
    return text[0], list(zip(*(text[1 + i :: 4] for i in range(4))))


def oracle(rules=RULES, iterations: int = ITERATIONS) -> str:
    """DuckDB SQL of judge()'s digest over `documents`, EM written out."""
    names = ", ".join(f"v{i}" for i in range(len(rules)))
    right = [(f"gg{i}", f"gb{i}", f"bg{i}", f"bb{i}") for i in range(len(rules))]
    cols = ["prior", *(c for group in right for c in group)]
    first = ", ".join(f"CAST({v} AS DOUBLE) AS {c}" for c, v in zip(cols, [PRIOR, *(ON_GOOD + ON_BAD) * len(rules)]))
    steps = "".join(
        f", e{k + 1} AS (SELECT {', '.join(f'{x} AS {c}' for x, c in zip(updates('p', len(rules)), cols))} FROM (SELECT patterns.*, {posterior('prior', right)} AS p FROM patterns, e{k}))" for k in range(iterations)
    )
    gap = "[\\x20\\x09-\\x0D]"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '{gap}+'), lambda x: x <> '') AS w, regexp_replace(t, '{gap}+', '', 'g') AS bare, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{gap}+', '', 'g') <> '') AS l FROM t),
x AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
y AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM x) WHERE n > 1),
z AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM y) GROUP BY r),
m AS (SELECT w.doc_id, len(w) AS n_words, length(bare) AS word_chars, length(bare) - length(regexp_replace(bare, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(z.n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(bare, '[\\p{{L}}\\p{{N}}]+', '', 'g')) AS n_marks,
 length(bare) - length(regexp_replace(bare, '\\p{{Lu}}+', '', 'g')) AS n_capitals, length(bare) - length(regexp_replace(bare, '[0-9]+', '', 'g')) AS n_digits FROM w LEFT JOIN z USING (r)),
v AS (SELECT *, {', '.join(f'{vote(r)} AS v{i}' for i, r in enumerate(rules))} FROM m),
patterns AS (SELECT {names}, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY {names}),
e0 AS (SELECT {first}){steps}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
 CAST(n_repeat_words AS BIGINT) AS n_repeat_words, ({BASE_FAILED}) AS base_failed, NOT ({BASE_FAILED}) AND {posterior('prior', right)} >= 0.5 AS kept FROM v, e{iterations}"""
