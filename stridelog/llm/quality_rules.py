"""Quality rules that vote or abstain, weighed by expectation-maximisation.

A text is good, or bad in one of several ways: each rule stands for a way of its own, which it
sees best. A single kind of bad text would not do: texts full of symbols pass the rules on repeats
and the other way round, so the one kind would become the larger group and clear the other. For
every way, and for good texts, each rule has its own probability to vote "bad" when it votes at
all; abstaining says nothing, since it depends on the length of a text.

Spark SQL only: the estimation runs over the histogram of vote patterns, which has at most
three to the power of the number of rules rows, as one array folded by ``aggregate``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, staged

WINDOW = 8
ROUNDS = 25
KEEP_FROM = 0.5
#: Probability of a vote "bad" to start from, counted like WEIGHT votes: by a rule on a text that is
#: bad in its way, and on any other text.
SEEN, STRAY, WEIGHT = 0.8, 0.02, 10
#: Bounds of these probabilities, on good texts, and of the shares.
LOWEST, HIGHEST, STRAYEST, LEAST_SHARE = 0.001, 0.999, 0.05, 0.001
#: Share of good texts to start from.
GOOD = 0.8

#: Each rule says 1 (good), -1 (bad) or 0 (abstains). Valid in Spark and in standard SQL.
RULES = {
    "length": "CASE WHEN n_words < 20 THEN -1 WHEN n_words >= 50 THEN 1 ELSE 0 END",
    "word_size": """CASE WHEN n_words = 0 THEN 0
        WHEN 10 * word_chars < 25 * n_words OR word_chars > 12 * n_words THEN -1
        WHEN word_chars >= 3 * n_words AND word_chars <= 9 * n_words THEN 1 ELSE 0 END""",
    "symbols": """CASE WHEN n_words = 0 THEN 0 WHEN 10 * n_symbols > n_words THEN -1
        WHEN 100 * n_symbols <= n_words THEN 1 ELSE 0 END""",
    "lines": """CASE WHEN n_lines < 2 THEN 0 WHEN 10 * n_dup_lines > 3 * n_lines THEN -1
        WHEN n_dup_lines = 0 THEN 1 ELSE 0 END""",
    "repeats": """CASE WHEN n_words < 20 THEN 0 WHEN 10 * n_repeat_words > 2 * n_words THEN -1
        WHEN n_repeat_words = 0 THEN 1 ELSE 0 END""",
    "variety": """CASE WHEN n_words < 20 THEN 0 WHEN 10 * n_distinct < n_words THEN -1
        WHEN 10 * n_distinct > 3 * n_words THEN 1 ELSE 0 END""",
}
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"

_SPACES = r"' \t\n\x0b\x0c\r'".replace(r"\x0b", r"\u000b").replace(r"\x0c", r"\u000c")
_BREAK = r"'[\\x20\\x09-\\x0D]+'"


def signals(docs: DataFrame) -> DataFrame:
    """Counts of each whole text, one row per input row; NULL and empty texts have no words.

    The words of windows found twice or more come from the sorted hashes of all windows of the
    text, and neighbours are compared word by word. Nothing is shuffled.
    """
    windows = ", ".join(f"get(words, i + {j})" for j in range(WINDOW))
    at = f"slice(words, {{}}.i + 1, {WINDOW})"
    same = "(get(sorted, {0}).h = w.h AND " + at.format("get(sorted, {0})") + " = " + at.format("w") + ")"
    return (
        docs.select("doc_id", F.expr("coalesce(text, '')").alias("text"))
        .withColumn("trimmed", F.expr(f"trim(BOTH {_SPACES} FROM text)"))
        .withColumn("words", F.expr(f"IF(trimmed = '', array(), split(trimmed, {_BREAK}))"))
        .withColumn("lines", F.expr("filter(split(text, '\\n'), l -> rlike(l, '[^\\\\x20\\\\x09-\\\\x0D]'))"))
        .withColumn("n_words", F.expr("CAST(size(words) AS BIGINT)"))
        .withColumn(
            "hashes",
            F.expr(
                f"IF(n_words <= {WINDOW}, array(), transform(sequence(0, size(words) - {WINDOW}),"
                f" i -> xxhash64({windows})))"
            ),
        )
        .withColumn(
            "sorted",
            F.expr(
                "IF(size(array_distinct(hashes)) = size(hashes), NULL,"
                " array_sort(transform(hashes, (h, i) -> struct(h, i))))"
            ),
        )
        .withColumn(
            "repeated",
            F.expr(
                f"array_sort(transform(filter(sorted, (w, k) -> {same.format('k - 1')} OR"
                f" {same.format('k + 1')}), w -> w.i))"
            ),
        )
        .select(
            "doc_id",
            "n_words",
            F.expr("CAST(length(array_join(words, '')) AS BIGINT)").alias("word_chars"),
            F.expr("CAST(regexp_count(text, '[#*$%&|<>]') AS BIGINT)").alias("n_symbols"),
            F.expr("CAST(size(lines) AS BIGINT)").alias("n_lines"),
            F.expr("CAST(size(lines) - size(array_distinct(lines)) AS BIGINT)").alias("n_dup_lines"),
            F.expr("CAST(size(array_distinct(words)) AS BIGINT)").alias("n_distinct"),
            F.expr(
                f"coalesce(aggregate(repeated, struct(0L AS n, -{WINDOW} AS last), (s, p) ->"
                f" struct(s.n + least({WINDOW}, p - s.last) AS n, p AS last), s -> s.n), 0L)"
            ).alias("n_repeat_words"),
        )
    )


def _start(rules: int) -> list[float]:
    """Probabilities of a vote "bad", class after class; class 0 is good, class j + 1 is rule j's."""
    return [SEEN if c == j + 1 else STRAY for c in range(rules + 1) for j in range(rules)]


def estimate(votes: DataFrame, rules: list[str], rounds: int = ROUNDS) -> DataFrame:
    """One row with ``model``: shares of the classes, and ``bad``: probabilities of votes "bad".

    Class 0 is good, class j + 1 bad in the way of rule j; ``bad`` has the rules' probabilities
    class after class. Given the class, rules vote independently. Patterns are counted before the
    shuffle; an empty input gives no row.
    """
    size = len(rules)
    patterns = votes.groupBy(F.array(*rules).alias("votes")).agg(F.count("*").alias("n"))
    listed = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    total = "aggregate(seen, 0D, (s, p) -> s + {})"
    first = ", ".join(f"{p}D" for p in _start(size))
    shares = ", ".join([f"{GOOD}D"] + [f"{(1 - GOOD) / size}D"] * size)
    start = f"named_struct('share', array({shares}), 'bad', array({first}))"
    seen = (
        "transform(patterns, p -> struct(p.votes AS votes, CAST(p.n AS DOUBLE) AS n, "
        + classes("p.votes", "m", size)
        + " AS q))"
    )
    share = (
        f"transform(sequence(0, {size}), c -> greatest({LEAST_SHARE}D, "
        + total.format("p.n * p.q[c]") + " / " + total.format("p.n") + "))"
    )
    highest = f"IF(i < {size}, {STRAYEST}D, {HIGHEST}D)"
    of = f"p.votes[i % {size}]"
    by = f"p.n * p.q[i DIV {size}]"
    bad = (
        f"transform(array({first}), (start, i) -> least({highest}, greatest({LOWEST}D, ("
        + total.format(f"IF({of} = -1, {by}, 0D)") + f" + start * {WEIGHT}) / ("
        + total.format(f"IF({of} <> 0, {by}, 0D)") + f" + {WEIGHT}))))"
    )
    # The array of one element binds the E step's result for the many sums of the M step.
    step = f"transform(array({seen}), seen -> named_struct('share', {share}, 'bad', {bad}))[0]"
    model = f"aggregate(sequence(1, {rounds}), {start}, (m, i) -> {step})"
    return listed.filter("size(patterns) > 0").select(F.expr(model).alias("model"))


def classes(votes: str, model: str, size: int) -> str:
    """SQL for the probability of each class, given votes."""
    evidence = (
        f"aggregate(sequence(0, {size - 1}), 0D, (s, j) -> s + CASE {votes}[j]"
        f" WHEN -1 THEN ln({model}.bad[c * {size} + j])"
        f" WHEN 1 THEN ln(1 - {model}.bad[c * {size} + j]) ELSE 0D END)"
    )
    weights = f"transform(sequence(0, {size}), c -> {model}.share[c] * exp({evidence}))"
    normal = "transform(w, x -> x / aggregate(w, 0D, (s, x) -> s + x))"
    return f"transform(array({weights}), w -> {normal})[0]"


def quality(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per input row: counts, base verdict, quality probability, and whether it is kept.

    ``kept`` is false where ``base_failed``, else whether the posterior reaches ``keep_from``.
    NULL and empty texts have zero counts and fail the base. Rows are independent but for the
    accuracies, which come from all rows; ids may be NULL or repeated; other columns of ``docs``
    are not read.
    """
    counted = staged(signals(docs), "signals")
    votes = counted.select("*", *[F.expr(sql).alias(f"v_{name}") for name, sql in RULES.items()])
    rules = [f"v_{name}" for name in RULES]
    model = estimate(votes, rules).scalar()
    return (
        votes.withColumn("votes", F.array(*rules))
        .withColumn("m", model)
        .withColumn("quality", F.expr(f"{classes('votes', 'm', len(rules))}[0]"))
        .withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_from))
    )


OUTPUT = (
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "base_failed", "kept",
)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).select(*OUTPUT)


def _sql() -> str:
    """The same estimation in standard SQL, one pair of steps after the other."""
    names = list(RULES)
    size = len(names)
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(
            f"""w{k} AS MATERIALIZED (
                SELECT id, n, c, share * exp(sum(CASE v WHEN -1 THEN ln(bad) WHEN 1 THEN ln(1 - bad)
                                                 ELSE 0 END)) AS w
                FROM votes JOIN b{k} USING (j) JOIN s{k} USING (c) GROUP BY id, n, c, share),
            q{k} AS MATERIALIZED (
                SELECT id, n, c, w / sum(w) OVER (PARTITION BY id) AS q FROM w{k})"""
        )
        if k < ROUNDS:
            steps.append(
                f"""s{k + 1} AS MATERIALIZED (
                SELECT c, greatest({LEAST_SHARE}, sum(n * q) / (SELECT sum(n) FROM patterns)) AS share
                FROM q{k} GROUP BY c),
            b{k + 1} AS MATERIALIZED (
                SELECT c, j, least(if(c = 0, {STRAYEST}, {HIGHEST}), greatest({LOWEST},
                           (sum(CASE v WHEN -1 THEN votes.n * q ELSE 0 END) + bad * {WEIGHT})
                           / (sum(CASE v WHEN 0 THEN 0 ELSE votes.n * q END) + {WEIGHT}))) AS bad
                FROM q{k} JOIN votes USING (id) JOIN b0 USING (c, j) GROUP BY c, j, bad)"""
            )
    shares = ", ".join(f"({c}, {GOOD if c == 0 else (1 - GOOD) / size}::DOUBLE)" for c in range(size + 1))
    start = ", ".join(f"({i // size}, {i % size}, {p}::DOUBLE)" for i, p in enumerate(_start(size)))
    votes = ", ".join(f"{sql} AS v_{r}" for r, sql in RULES.items())
    columns = ", ".join(f"v_{r}" for r in names)
    listed = " UNION ALL ".join(
        f"SELECT id, n, {j} AS j, v_{r} AS v FROM patterns" for j, r in enumerate(names)
    )
    same = " AND ".join(f"voted.v_{r} = patterns.v_{r}" for r in names)
    return rf"""
        WITH split AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)),
                               lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
            FROM documents
        ),
        places AS (
            SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w
            FROM split, range(1, len(words) - {WINDOW - 2}) AS r(i)
        ),
        twice AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM places
        ),
        covered AS (
            SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_repeat_words
            FROM twice, range(0, {WINDOW}) AS r(j) WHERE n > 1 GROUP BY doc_id
        ),
        counted AS (
            SELECT s.doc_id, len(words)::BIGINT AS n_words,
                   length(array_to_string(words, ''))::BIGINT AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                   len(lines)::BIGINT AS n_lines,
                   (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                   len(list_distinct(words))::BIGINT AS n_distinct,
                   coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id
        ),
        voted AS MATERIALIZED (SELECT *, {votes} FROM counted),
        patterns AS MATERIALIZED (
            SELECT row_number() OVER () AS id, * FROM (
                SELECT {columns}, count(*)::DOUBLE AS n FROM voted GROUP BY ALL)),
        votes AS MATERIALIZED ({listed}),
        s0 AS MATERIALIZED (SELECT * FROM (VALUES {shares}) AS t(c, share)),
        b0 AS MATERIALIZED (SELECT * FROM (VALUES {start}) AS t(c, j, bad)),
        {", ".join(steps)}
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               {BASE_FAILED} AS base_failed,
               NOT ({BASE_FAILED}) AND q >= {KEEP_FROM} AS kept
        FROM voted JOIN patterns ON {same} JOIN q{ROUNDS} USING (id) WHERE c = 0
    """


SQL = {"op2_quality_rules": _sql()}
